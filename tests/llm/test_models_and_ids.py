"""Top-k search, toxicity, prediction by partial matching, token ids and main text against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustlake.llm import bpe, common, html, packing, ppm, topk, toxicity
from trustlake.llm.queries import tokenizer_files


# --- top-k -------------------------------------------------------------------------------------------------------


def vectors():
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(120)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, rows[0][1])]  # ties
    rows += [(300, None), (301, [0.1, None]), (302, [0.1, float("nan")]), (303, [float("inf")]), (None, [1.0])]
    rows += [(400, []), (401, [0.5]), (402, [0.0] * 6), (403, [1e30] * 6), (403, [1e30] * 6)]
    return rows


def brute_top(rows, k, every):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    usable = [(i, [cut(x) for x in v]) for i, v in usable]
    out = collections.Counter()
    for q, a in usable:
        if q % every == 0:
            scores = sorted((-cut(sum(x * y for x, y in zip(a, b))), i) for i, b in usable if i != q)
            out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k]))
    return out


@pytest.mark.parametrize("shard, block", [(8192, 2048), (16, 7)])
def test_top_k(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    monkeypatch.setattr(topk, "DEPTH", 4)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(
        "vec_id", topk.integers("embedding").alias("vector"), F.lit("clash").alias("score")
    )
    got = topk.top_k(df, df.filter(F.col("vec_id") % 5 == 0), 5).collect()
    assert collections.Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, 5, 5)
    assert topk.top_k(df.limit(0), df, 5).count() == 0 and topk.top_k(df, df.limit(0), 5).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(4)
    rows = rng.integers(-3, 4, (4000, 4))
    rows[17] = 300
    lists = topk.SortedLists(np.arange(4000), rows.astype(np.int64))
    met = []
    scorer = lists._scorer
    lists._scorer = lambda q: (lambda f: lambda at: met.append(len(at)) or f(at))(scorer(q))
    ids, scores = lists.search(-1, np.array([5, 1, 1, 1]), 1)
    assert ids.tolist() == [17] and scores.tolist() == [2400] and sum(met) < 1000


# --- toxicity ----------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_documents(spark):
    rnd = random.Random(11)
    stems, bad = [f"{a}{b}" for a in "bdfglmn" for b in ("an", "er", "ol", "in")], ["zwak", "zwik"]
    word = lambda: "".join(rnd.choice(stems) for _ in range(rnd.randint(1, 3)))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rnd.randint(40, 120))]
        toxic = i % 5 == 0
        if toxic:  # endings that training has not seen
            for _ in range(4):
                words[rnd.randrange(len(words))] = rnd.choice(bad) + word()
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "a b " * 50_000), (2001, "")]
    labels += [(5, None), (5, 1), (9999, 1), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    out = toxicity.scored(docs, marks, learn=~held).withColumn("held", held).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held_out = [r for r in out if r.held and r.doc_id < 900]
    caught = [r.score >= 0.7 for r in held_out if r.doc_id % 5 == 0]
    blamed = [r.score >= 0.7 for r in held_out if r.doc_id % 5]
    assert sum(caught) >= 0.9 * len(caught) and sum(blamed) <= 0.02 * len(blamed)


def test_toxicity_without_training(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, labels, F.lit(True)).collect()} == {0.0}
    assert toxicity.scored(docs, labels.limit(0), F.lit(True)).count() == 2
    both = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.scored(docs, both, F.lit(True)).collect())


def test_class_models_are_distributions():
    words = [b"zwak", b"banane", b"banaan", b"\xc3\xa4pfel"]
    key, of = toxicity.grams(words)
    keys, inverse = np.unique(key, return_inverse=True)
    n = np.bincount(inverse)
    shared = toxicity._interpolated(keys, n.astype(float), toxicity._continued(keys))
    _, at = np.unique(keys >> 8, return_inverse=True)
    assert (np.bincount(at, shared) <= 1 + 1e-9).all() and (shared > 0).all()
    assert len(key) == sum(len(w) + 1 for w in words)


# --- prediction by partial matching ------------------------------------------------------------------------------


def brute_ppm(texts, learn):
    tokens = [[*t.lower().split(), b"\n"] for t in texts]
    train = collections.Counter(w for row, ok in zip(tokens, learn) if ok for w in row)
    streams = [b" " + b" ".join(row) for row in tokens]
    trie = collections.defaultdict(collections.Counter)
    for s, ok in zip(streams, learn):
        for i in range(1, len(s) if ok else 0):
            for k in range(min(ppm.ORDER, i) + 1):
                trie[k, s[i - k : i]][s[i]] += 1

    def byte(s, i):
        p, out = 0.0, set()
        for k in range(min(ppm.ORDER, i), -1, -1):
            seen = trie.get((k, s[i - k : i]))
            if not seen:
                continue
            n, q = sum(c for x, c in seen.items() if x not in out), len(set(seen) - out)
            if s[i] in seen:
                return p + math.log10(seen[s[i]] / (n + q))
            p += math.log10(q / (n + q)) if q else 0.0
            out = set(seen)
        return p - math.log10(256 - len(out))

    rows = []
    for row, s in zip(tokens, streams):
        score = sum(byte(s, i) for i in range(1, len(s)))
        rows.append((len(row), sum(train[w] > 0 for w in row), sum(math.log10(train[w] + 1) for w in row), score))
    return rows, sum(train.values()), len(train)


def test_ppm(spark, docs, doc_rows, monkeypatch):
    monkeypatch.setattr(ppm, "BATCH_BYTES", 20_000)
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    kept = {r.doc_id: r.ok for r in docs.select("doc_id", learn.alias("ok")).distinct().collect()}
    want, tokens, distinct = brute_ppm([(r[1] or "").encode() for r in doc_rows], [kept[r[0]] for r in doc_rows])
    out, n, v = ppm.scored(docs, learn)
    assert (n, v) == (tokens, distinct)
    order = lambda x: (x[0] is None, x[0], *(round(y, 6) for y in x[1:]))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.log_counts, r.score) for r in out.collect()), key=order)
    for g, w in zip(got, sorted(((r[0], *x) for r, x in zip(doc_rows, want)), key=order), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3]) and g[4] == pytest.approx(w[4])


def test_ppm_reads_across_words(spark):
    text = "alpha beta gamma delta"
    rows = [(i, text) for i in range(20)] + [(100, text), (101, "delta gamma beta alpha")]
    out, _, _ = ppm.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 100)
    score = {r.doc_id: r.score for r in out.collect()}
    assert score[0] == score[100] > score[101] + 3


def test_grams_of_short_streams():
    streams = [b" \n", b" a \n", b" \n"]
    width = 8 * (ppm.ORDER + 1)
    got = [(int(k >> width), int(k & ((1 << width) - 1)).to_bytes(ppm.ORDER + 1, "big").lstrip(b"\0")) for k in ppm.grams(streams)]
    assert got == [(1, b" \n"), (1, b" a"), (2, b" a "), (3, b" a \n"), (1, b" \n")]


@pytest.mark.parametrize("rows", [0, 2])
def test_ppm_with_hot_grams_and_clashing_columns(spark, docs, doc_rows, monkeypatch, rows):
    monkeypatch.setattr(common, "HOT_ROWS", rows)
    monkeypatch.setattr(ppm, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(ppm, "GROUP_GRAMS", 3_000)
    names = {n: F.lit(f"own {n}") for n in ("kept", "learn", "learn0", "word", "gram", "n", "asks", "_batch", "_learn", "value")}
    want, *_ = brute_ppm([(r[1] or "").encode() for r in doc_rows], [True] * len(doc_rows))
    out, _, _ = ppm.scored(docs.withColumns(names), F.lit(True))
    got = out.collect()
    assert all(r[n] == f"own {n}" for r in got for n in names)
    assert sorted(r.score for r in got) == pytest.approx(sorted(w[3] for w in want))


def test_ppm_asks_for_words_in_one_shuffle(docs):
    out, _, _ = ppm.scored(docs, F.lit(True))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Join Inner, (gram" in plan  # words are answered from where they were counted


def test_ppm_without_training(docs, no_docs, doc_rows):
    out, n, v = ppm.scored(docs.filter("doc_id < 9"), F.lit(False))
    assert (n, v) == (0, 0)
    for r in out.collect():
        symbols = sum(len(w) + 1 for w in r.text.encode().split()) + 1
        assert r.n_known == 0 and r.score == pytest.approx(-symbols * math.log10(256))
    assert ppm.scored(no_docs, F.lit(True))[0].count() == 0


# --- token ids ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    path, _ = tokenizer_files()
    return bpe.read_ranks(path)


def awkward():
    rnd = random.Random(1)
    letters = "ab the'sLL'll 12٣\t\n\r\x0b\x85   é中😀́﻿᠎​\x00\x1c_-§½"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    wide = [(0, 0x24F), (0x370, 0x1FFF), (0x2000, 0xD7FF), (0x10000, 0x1FFFF)]
    texts += ["".join(chr(rnd.randint(*rnd.choice(wide))) for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    return [*texts, None, "", "<|endoftext|>", "   ", "x" * 3000, " \n" * 500]


def test_bpe_is_the_rank_files_encoding(spark, ranks):
    tiktoken = pytest.importorskip("tiktoken")
    _, pattern = tokenizer_files()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = awkward()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, ranks, pattern), ranks).withColumn("back", bpe.decoded_text()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.ids == encoding.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode() and r.back == text
    assert bpe.encode(df.limit(0), ranks, pattern).count() == 0
    both = bpe.round_trip(df, ranks, pattern).collect()
    assert {r.doc_id: (r.ids, r.decoded) for r in both} == {r.doc_id: (r.ids, r.decoded) for r in rows}


def test_bpe_token_of_a_whole_match_only(spark):
    # no merge reaches abc, but a match that is abc is that token
    odd = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"de": 257}
    rows = spark.createDataFrame([("abc",), ("xabc",), ("de",), ("xde",)], "text string")
    out = bpe.encode(rows, odd, r"\S+")
    assert {r.text: list(r.ids) for r in out.collect()} == {"abc": [256], "xabc": [120, 97, 98, 99], "de": [257], "xde": [120, 257]}
    with pytest.raises(ValueError):
        bpe.tokenizer_json({b"a": 0}, r"\S+")


def test_bpe_offsets(spark, ranks):
    _, pattern = tokenizer_files()
    text = "Äpfel, naïve 中文 😀 done"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = bpe.encode(df, ranks, pattern, offsets="spans").first()
    assert r.ids == bpe.encode(df, ranks, pattern).first().ids and len(r.spans) == len(r.ids)
    assert all(0 <= s.start < s.end <= len(text) for s in r.spans)
    covered = {i for s in r.spans for i in range(s.start, s.end)}
    assert covered == set(range(len(text)))


def test_bpe_split_characters_and_unknown_ids(spark, ranks):
    half = [ranks[bytes([b])] for b in "é".encode()]
    df = spark.createDataFrame([(1, half), (2, half[:1]), (3, None), (4, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.back for r in bpe.decode(df, ranks).withColumn("back", bpe.decoded_text()).collect()}
    assert got == {1: "é", 2: "�", 3: "", 4: ""}
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), ranks).collect()


def test_packing_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_TOKENS", 3000)
    rnd = random.Random(3)
    ids = {i: [rnd.randrange(60_000) for _ in range(rnd.choice([0, 1, 5, 63, 64, 65, 200]))] for i in range(200)}
    rows = [(i, x, "clash") for i, x in ids.items()] + [(500, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, row string").repartition(3)
    packs = packing.packed(df, length=64, pad=7, kind="<u2").withColumn("positions", packing.positions())
    got = collections.defaultdict(list)
    for r in sorted(packing.unpacked(packs, "<u2").collect(), key=lambda r: (r.doc_id, r.offset)):
        assert r.offset == len(got[r.doc_id])
        got[r.doc_id] += r.ids
    assert dict(got) == {i: x for i, x in ids.items() if x}
    total = 0
    for r in packs.collect():
        line = np.frombuffer(r.ids, "<u2")
        assert len(line) == 64 and (line[r.n_tokens :] == 7).all() and r.cu_seqlens[-1] == r.n_tokens <= 64
        assert r.resets == r.cu_seqlens[:-1] == [i for i, p in enumerate(r.positions) if p == 0]
        assert len(r.positions) == r.n_tokens and len(r.doc_ids) == len(r.offsets) == len(r.resets)
        total += r.n_tokens
    assert total == sum(map(len, ids.values()))
    assert packing.packed(df.limit(0)).count() == 0


def test_best_fit_decreasing_takes_the_tightest_row():
    rnd = random.Random(8)
    for _ in range(50):
        lengths = [rnd.randint(1, 50) for _ in range(rnd.randint(0, 60))]
        rows, rooms = [], []
        for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fitting = [room for room in rooms if room >= lengths[piece]]
            if fitting:
                rooms.remove(min(fitting))
                rooms.append(min(fitting) - lengths[piece])
            else:
                rooms.append(50 - lengths[piece])
        rows = packing.best_fit_decreasing(lengths, 50)
        assert sorted(50 - sum(lengths[p] for p in row) for row in rows) == sorted(rooms)
        assert sorted(p for row in rows for p in row) == list(range(len(lengths)))


# --- main text ---------------------------------------------------------------------------------------------------


def page(article, n):
    links = "".join(f'<li><a href="/{i}">link {i}</a>' for i in range(n))
    return (
        f"<!DOCTYPE html><html><head><title>Title {n} &amp; more</title><style>p{{}}</style>"
        f'<script>var t="</p><article>no</article>";</script></head><body><nav><ul>{links}</ul></nav>'
        f'<div class="site-header"><header>Site</header></div><div class="ad banner">Buy {n}!</div>{article}'
        f"<aside>More</aside><div class='cookie-notice'>We use cookies</div><form><input name=q>Search</form>"
        f'<div id="comments"><p>First {n}!</p></div><footer>&copy; {n}</footer>'
    )


def test_main_text(spark):
    body = "<h1>A &lt;B&gt; &amp; C&eacute;</h1><p>One <b>two\n\t three<br>four<p>five&nbsp;six</div><!-- x <p>y -->"
    want = "A <B> & Cé\nOne two three\nfour\nfive six"
    rows = [(i, f"http://Www.Host.example:80/{i}?q", page(f"<article>{body}</article>", i % 4 + 1)) for i in range(8)]
    rows += [(20 + i, f"https://b.example/{i}", page(f'<div class="entry"><p>{"long text here " * 20} {i}</p></div>', 2)) for i in range(4)]
    rows += [(30, None, page(f"<article>{body}</article>", 1)), (31, "not a url", None), (32, "http://x.example", "")]
    rows += [(33, "http://x.example", "plain text, no markup"), (34, "http://Www.Host.example/z", "<p>other layout</p>")]
    rows += [(35, "http://y.example", "<article><p>" + "word " * 50_000 + "</article>"), rows[0]]
    rows += [(36, "http://y.example", "<div>" * 3000 + "deep"), (37, "http://y.example", "<article>a<!-- open <p>b"), (38, "", "<a href='x")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = collections.defaultdict(list)
    for r in html.main_text(pages).collect():
        got[r.page_id].append(r.main_text)
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i] == [want] * (2 if i == 0 else 1) for i in range(8)) and got[30] == [want]
    assert all(got[20 + i] == [f"{'long text here ' * 20}{i}"] for i in range(4))
    assert got[31] == [""] and got[32] == [""] and got[38] == [""]
    assert got[33] == ["plain text, no markup"] and got[34] == ["other layout"]
    assert got[35] == [("word " * 50_000).strip()] and got[36] == ["deep"] and got[37] == ["a"]
    assert html.main_text(pages.limit(0)).count() == 0


def test_template_classes(spark):
    pages = spark.createDataFrame(
        [("h", page(f"<article><p>a{'x' * n}<p>b<div class=box>Join us</div></article>", n)) for n in (1, 2, 3)], "host string, html string"
    )
    rows = html.tokens(pages).collect()
    found = {r.label: r for r in rows if r.kind == 0}
    vector = lambda r: (r.pages, r.total, r.a, r.b)
    assert vector(found[""]) == vector(found["article"]) == vector(found["nav"])
    assert vector(found["li"]) == vector(found["a"]) != vector(found[""]) and vector(found["p"]) not in (vector(found[""]), vector(found["li"]))
    row = html.templates(html.tokens(pages)).first()
    assert (row.host, row.pages) == ("h", 3) and row.classes >= 3
    assert {e.label for e in row.skeleton} >= {"", "html", "body", "article", "nav"}
    # texts of the skeleton's class: the header, the box and the paragraph that all pages share, not those that differ
    shared = {x: [r.token for r in rows if r.kind == 1 and r.pages == 3 and r.above == found[x].token] for x in ("header", "div.box", "p")}
    assert all(len(x) == 1 for x in shared.values()) and sorted(row.texts) == sorted(sum(shared.values(), []))


def prose(seed, n=40):
    return " ".join(f"w{(seed * 37 + i * i) % 1000}" for i in range(n))


def extracted(spark, articles, host="h.example"):
    rows = [(i, f"http://{host}/{i}", f"<html><body>{a}</body></html>") for i, a in enumerate(articles)]
    out = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return [r.main_text for r in out.orderBy("page_id").collect()]


def test_template_deduction(spark, monkeypatch):
    monkeypatch.setattr(html, "TASK_PAGES", 2)  # large hosts take the salted way
    box = "<div class=box7><p>Read our house rules before you write to us</p></div>"
    # a heading beside one paragraph, an article in two parts, a name that only looks like boilerplate
    assert extracted(spark, [f"<div class=entry><h1>Head {prose(i, 3)}</h1><p>{prose(i)}</p></div>" for i in range(6)]) == [
        f"Head {prose(i, 3)}\n{prose(i)}" for i in range(6)
    ]
    assert extracted(spark, [f"<div class=lead>{prose(i, 30)}</div><div class=body>{prose(i + 50, 20)}</div>" for i in range(6)]) == [
        f"{prose(i, 30)}\n{prose(i + 50, 20)}" for i in range(6)
    ]
    assert extracted(spark, [f"<article><p>{prose(i)}</p><div class=search-results-story>{prose(i + 9)}</div></article>" for i in range(4)]) == [
        f"{prose(i)}\n{prose(i + 9)}" for i in range(4)
    ]
    # a block that repeats under an unlisted name goes, on every page and in a layout that a part of the pages has
    assert extracted(spark, [f"<article><h1>T {prose(i, 2)}</h1>{box}<p>{prose(i)}</p></article>" for i in range(6)]) == [
        f"T {prose(i, 2)}\n{prose(i)}" for i in range(6)
    ]
    assert extracted(spark, [f"<article><p>{prose(i)}</p>{box if i % 2 else ''}</article>" for i in range(8)]) == [prose(i) for i in range(8)]
    assert extracted(spark, [f"<section class=thread><p>Posted under the rules</p></section><div>{prose(i)}</div>" for i in range(5)]) == [
        prose(i) for i in range(5)
    ]


def test_copies_are_no_template(spark):
    text = "".join(f"<p>{prose(i)}</p>" for i in range(3))
    want = "\n".join(prose(i) for i in range(3))
    assert extracted(spark, [f"<article>{text}</article>"] * 6) == [want] * 6
    # near copies: what differs is less than what they share
    near = extracted(spark, [f"<article>{text}<p>edit {prose(90 + i, 3)}</p></article>" for i in range(6)])
    assert near == [f"{want}\nedit {prose(90 + i, 3)}" for i in range(6)]
    # copies on a part of the pages of a host
    some = extracted(spark, [f"<article><p>{prose(i if i > 3 else 0)}</p><p>{prose(500 + (i if i > 3 else 0))}</p></article>" for i in range(9)])
    assert some == [f"{prose(i if i > 3 else 0)}\n{prose(500 + (i if i > 3 else 0))}" for i in range(9)]


def test_html_at_any_depth_and_with_clashing_columns(spark):
    deep = "".join(f"<div class=c{chr(97 + i % 26)}>" for i in range(400))
    rows = [(i, "http://d.example", f"{deep}<div class=note>same words here</div><p>{prose(i)}</p>") for i in range(4)]
    own = {n: F.lit(f"own {n}") for n in ("host", "_host", "_at", "_article", "salt", "salts", "skeleton", "texts", "token")}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(own)
    got = html.main_text(pages).collect()
    assert sorted(r.main_text for r in got) == sorted(prose(i) for i in range(4))
    assert all(r[n] == f"own {n}" for r in got for n in own)


def test_names_do_not_empty_a_page():
    article = "<h1>Head</h1><p>long text</p>"
    for whole in (
        f"<html><body class='no-sidebar search'><div class='menu'>m</div><article>{article}</article></body></html>",
        f"<body><div id='main' class='has-comments'><div>Head<br>long text</div><div class='comments'>c</div></div></body>",
        f"<body><div role='main' id='with-banner'>{article}</div></body>",
        f"<body><main class='widget'>{article}</main></body>",
        f"<body><article id='search-history'>{article}</article><article class='comment'>c</article></body>",
    ):
        assert html.slot_text(whole) == "Head\nlong text", whole
