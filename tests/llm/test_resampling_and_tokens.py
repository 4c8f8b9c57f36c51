"""Operators 11 to 13 against brute force and the tokenizers' own libraries."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from trustlake.llm import alignment, common, counting, importance
from trustlake.llm.bpe import byte_characters
from trustlake.llm.common import stored
from trustlake.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
PATH_A, PATH_B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def odd_texts(n, seed=3):
    rnd = random.Random(seed)

    def character():
        return chr(rnd.choice([32, 32, 10, rnd.randint(1, 0x7F), rnd.randint(1, 0x7FF), rnd.randint(0x800, 0xD7FF), rnd.randint(0x10000, 0x10FFFF)]))

    texts = ["", "a", " ", "  ", "a b", " a ", "x  ", "a▁b", "<|endoftext|> x<|endoftext|><|endoftext|>", "<s>", "é中文 ok", "\n", "a\n b"]
    return texts + ["aaaa" * 40, "日本語テキスト"] + ["".join(character() for _ in range(rnd.randint(1, 40))) for _ in range(n)]


# ---- 13: token counts


@pytest.fixture(scope="module")
def tokenizer():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH_A)


def lengths(tokenizer, texts):
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_are_the_librarys(tokenizer):
    texts = odd_texts(1500)
    counter = counting.Counter(open(PATH_A, encoding="utf-8").read())
    assert counter.counts(texts).tolist() == lengths(tokenizer, texts)


def test_memory_of_pre_tokens_does_not_change_counts(tokenizer, monkeypatch):
    monkeypatch.setattr(counting, "REMEMBERED", 5)
    texts = odd_texts(100)
    counter = counting.Counter(open(PATH_A, encoding="utf-8").read())
    assert [counter.counts([t])[0] for t in texts] == lengths(tokenizer, texts)


def test_a_long_pre_token(tokenizer):
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdefgh") for _ in range(60_000)) + "a" * 10_001
    counter = counting.Counter(open(PATH_A, encoding="utf-8").read())
    assert counter.counts([text]).tolist() == lengths(tokenizer, [text])


def test_safe_characters_have_the_librarys_classes(tokenizer):
    regex = pytest.importorskip("regex")
    find = regex.compile(counting.PATTERN).finditer
    for low, high in counting.SAFE:
        for start in range(low, high + 1, 500):
            text = "".join(f"a{c}a 1{c}1 .{c}. " for c in map(chr, range(start, min(start + 500, high + 1))))
            assert [s for _, s in tokenizer.pre_tokenizer.pre_tokenize_str(text)] == [m.span() for m in find(text)]


def test_ragged_merging_takes_overlaps_from_the_left():
    # a=0 b=1, then aa, aab
    vocab = {c: i for i, c in enumerate(byte_characters())}
    a, b = byte_characters()[97], byte_characters()[98]
    merges = counting.Merges({"vocab": {**vocab, a + a: 256, a + a + b: 257}, "merges": [[a, a], [a + a, b]]})
    pieces = [b"a", b"aaa", b"aaab", b"aaaab", b"baab", b"x"]
    assert counting.merged_counts(pieces, merges).tolist() == [1, 2, 3, 2, 2, 1]


def test_unordered_merges_are_refused():
    vocab = {c: i for i, c in enumerate(byte_characters())}
    with pytest.raises(ValueError):
        counting.Merges({"vocab": {**vocab, "aa": 256, "aab": 257}, "merges": [["aa", "b"], ["a", "a"]]})
    with pytest.raises(ValueError):
        counting.byte_level(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_token_counts(docs, doc_rows, no_docs, tokenizer):
    out = counting.token_counts(docs, PATH_A, limit=100)
    assert out.columns == [*docs.columns, "n_bytes", "n_tokens", "over_limit"]
    texts = [r[1] for r in doc_rows]
    want = collections.Counter(
        (r[0], len((r[1] or "").encode()), n, n > 100) for r, n in zip(doc_rows, lengths(tokenizer, texts))
    )
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()) == want
    assert counting.token_counts(no_docs, PATH_A).count() == 0


def test_op13(spark, sf, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(texts, lengths(tokenizer, texts.values())))
    rows = QUERIES["op13_token_counts"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), want[r.doc_id], want[r.doc_id] > 512)


# ---- 12: importance resampling


def features(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resampling(rows, target, min_words=20):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = collections.Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for doc_id, text in rows:
        n, found = features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, n])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        r[4] = rank
    return collections.Counter(tuple(r[:5]) for r in out)


def test_resampling(docs, doc_rows, no_docs, spark, monkeypatch):
    monkeypatch.setattr(importance, "PIVOTS", 3)
    rows = [(r[0], r[1]) for r in doc_rows]
    target = [r[1] for r in doc_rows[5:9]] + [None, ""]
    targets = spark.createDataFrame([(t,) for t in target], "text string")
    many = docs
    for _ in range(3):  # repeated rows, so that there are ties of whole keys
        many, rows = many.unionAll(many), rows + rows
    out = importance.resampled(many, targets)
    made = ["n_words", "n_features", "weight", "score", "rank"]
    assert out.columns == [c for c in docs.columns if c not in made] + made
    want = brute_resampling(rows, target)
    got = collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect())
    assert got == want
    assert importance.resampled(no_docs, targets).count() == 0
    empty = importance.resampled(docs, spark.createDataFrame([], "text string"))
    got = collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in empty.collect())
    assert got == brute_resampling([(r[0], r[1]) for r in doc_rows], [])


def test_resampling_with_text_ids(spark):
    rows = [(f"d{i:03}", " ".join(f"w{(i * j) % 17}" for j in range(25))) for i in range(60)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id string, text string, _slice string, _id int")
    out = importance.resampled(df, df.filter("doc_id < 'd010'").select("text"))
    want = brute_resampling(rows, [t for d, t in rows if d < "d010"])
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()) == want
    assert {(r["_slice"], r["_id"]) for r in out.collect()} == {("x", 1)}


@pytest.mark.parametrize("pivots", [1, 2, 32])
def test_kth_key_is_exact(spark, monkeypatch, pivots):
    monkeypatch.setattr(importance, "PIVOTS", pivots)
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 5), None if i % 7 == 0 else f"s{i % 9}", i) for i in range(40)]
    keys = sorted(rows, key=importance._order)
    df = spark.createDataFrame(rows, "a int, b string, c int")
    for k in (1, 2, 17, 39, 40):
        assert importance.kth_key(df, ["a", "b", "c"], k) == keys[k - 1]
    assert importance.kth_key(df, ["a", "b", "c"], 41) is None


def test_ranks_over_slices(spark, monkeypatch):
    monkeypatch.setattr(importance, "SLICE_ROWS", 10)
    values = list(range(0, 400, 3))
    random.Random(2).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = {r.v: r["rank"] for r in importance.ranked(df, ["v"], len(values)).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values), 1)}


def test_op12(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = QUERIES["op12_resampling"](spark, sf).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_resampling(rows, target)


# ---- 11: alignment of two tokenizers


def brute_alignment(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), token by token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    back = {c: i for i, c in enumerate(byte_characters())}

    def spans(tokens):
        ends = [0]
        for t in tokens:
            ends.append(ends[-1] + len(t))
        return list(zip(ends, ends[1:]))

    found, docs = [], collections.Counter()
    for text in texts:
        ids_a, ids_b, span_a, span_b = [], [], [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
            shown = [b.id_to_piece(i) for i in ids_b]
            bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, shown)]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                span_a, span_b = spans(bytes_a), spans(bytes_b)
            else:
                ids_a, ids_b = [], []
        groups, low = [], 0
        for cut in sorted({e for _, e in span_a} & {e for _, e in span_b}):
            sides = [[str(i) for i, (_, e) in zip(ids, span) if low < e <= cut] for ids, span in ((ids_a, span_a), (ids_b, span_b))]
            groups.append("|".join(map(",".join, sides)))
            low = cut
        links, first = [], 0
        for i, (start, end) in zip(ids_a, span_a):
            while first < len(span_b) and span_b[first][1] <= start:
                first += 1
            j = first
            while j < len(span_b) and span_b[j][0] < end:
                links.append((i, ids_b[j]))
                j += 1
        docs.update(set(links))
        found.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    most = collections.Counter()
    for (i, _), n in docs.items():
        most[i] = max(most[i], n)
    return [
        (n_a, n_b, n, len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), groups)
        for n_a, n_b, n, links, groups in found
    ]


def digest(groups):
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def test_aligned_texts():
    texts = odd_texts(300)
    align = alignment.Aligner(open(PATH_A, encoding="utf-8").read(), open(PATH_B, "rb").read())
    counts, groups, _, _ = align(texts)
    got = [(*row, g) for *row, g in zip(*(c.tolist() for c in counts), groups.to_pylist())]
    assert got == [(*r[:4], r[6]) for r in brute_alignment(texts)]


@pytest.mark.parametrize("limits", [{}, {"UNITS": 30, "TOGETHER": 3, "REMEMBERED": 10}, {"UNIT_CHARS": 40}])
def test_aligned_units(monkeypatch, limits):
    # white space of all kinds before, between and after words, cut into units that are remembered and forgotten
    for name, most in limits.items():
        monkeypatch.setattr(alignment, name, most)
    rnd = random.Random(5)
    parts = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u1680", "\u180e", "\u2028", "\u3000", "\u0301", "▁", "ﬁ", "ދ"]
    parts += ["the", "don't", "'s", "x.", "12", "é", "日本", "€", "over-long", "The"] * 3
    texts = odd_texts(60) + ["".join(rnd.choices(parts, k=rnd.randint(1, 14))) for _ in range(1500)] + ["the x. the"] * 5
    align = alignment.Aligner(open(PATH_A, encoding="utf-8").read(), open(PATH_B, "rb").read())
    got, links = [], []
    for i in range(0, len(texts), 50):
        counts, groups, doc, pair = align(texts[i : i + 50])
        got += [(*row, g) for *row, g in zip(*(c.tolist() for c in counts), groups.to_pylist())]
        links += zip((doc + i).tolist(), (pair >> 32).tolist(), (pair & 0xFFFFFFFF).tolist())
    want = brute_alignment(texts)
    assert got == [(*r[:4], r[6]) for r in want]
    docs, most = collections.Counter((a, b) for _, a, b in set(links)), collections.Counter()
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    sums, best = collections.Counter(), collections.Counter()
    for d, a, b in links:
        sums[d] += docs[a, b]
        best[d] += docs[a, b] == most[a]
    assert [(best[d], sums[d]) for d in range(len(texts))] == [r[4:6] for r in want]


def test_frequent_words_are_encoded_once():
    # however many others come between them
    align = alignment.Aligner(open(PATH_A, encoding="utf-8").read(), open(PATH_B, "rb").read())
    asked, model = collections.Counter(), align.b.model

    class Spy:
        def encode(self, texts, **options):
            asked.update(texts)
            return model.encode(texts, **options)

    align.b.model = Spy()
    frequent = [f"often{i}" for i in range(100)]
    for k in range(10):
        align([" ".join(frequent + [f"w{k}x{i}" for i in range(j, j + 1500)]) for j in range(0, 45_000, 1500)])
    assert len(asked) > 400_000 and {asked[w] for w in frequent} == {1}


@pytest.mark.parametrize("hot", [100_000, 1])
def test_alignment_counts(spark, docs, doc_rows, monkeypatch, hot):
    # small batches; with hot = 1 every pair of two batches or more is answered by broadcast
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 2_000)
    texts = odd_texts(40)
    rows = [(r[0], r[1]) for r in doc_rows] + [(10_000 + i, t) for i, t in enumerate(texts)]
    clashing = docs.select("doc_id", "text", F.lit("x").alias("batch"), F.lit("y").alias("pair"), F.lit("z").alias("at"))
    more = spark.createDataFrame([(10_000 + i, t, "x", "y", "z") for i, t in enumerate(texts)], clashing.schema)
    out = alignment.counted(stored(alignment.linked(clashing.unionAll(more), PATH_A, PATH_B), "linked"))
    assert out.columns == ["doc_id", "text", "batch", "pair", "at", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    got = collections.Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in out.collect())
    assert got == collections.Counter((d, *r) for (d, _), r in zip(rows, brute_alignment([t for _, t in rows])))


def test_alignment_of_nothing(no_docs):
    assert alignment.counted(stored(alignment.linked(no_docs, PATH_A, PATH_B), "linked")).count() == 0


def test_op11(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(texts, brute_alignment(texts.values())))
    rows = QUERIES["op11_alignment"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (*w[:6], digest(w[6]))
