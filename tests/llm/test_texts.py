"""Quality rules, mixing, near-duplicates and repeated passages against brute force."""

import collections
import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from trustlake.llm import graph, mixing, quality, simhash, substrings


def words_of(text):
    return (text or "").encode().split()


def test_quality_measures(docs, doc_rows):
    got = collections.Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        for r in quality.measured(docs).collect()
    )
    want = collections.Counter()
    for doc_id, text, *_ in doc_rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = collections.Counter(windows)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        want[(doc_id, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))] += 1
    assert got == want


def test_quality_verdicts(docs, doc_rows, no_docs):
    rows = quality.judged(quality.measured(docs)).collect()
    assert len(rows) == len(doc_rows)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
        assert r.key == "clash" or r.doc_id is None
    assert quality.judged(quality.measured(no_docs)).count() == 0


def test_bad_host_is_strict(spark):
    good = " ".join(f"w{i}" for i in range(60))
    soft = good + " " + "# " * 30
    rows = [(i, soft if i % 10 else good, "bad") for i in range(100)] + [(100 + i, soft if i % 20 == 0 else good, "fine") for i in range(100)]
    out = quality.judged(quality.measured(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    kept = {(r.source, "#" in r.text): r.n for r in out.filter("kept").groupBy("source", "text").agg(F.count("*").alias("n")).collect()}
    # clean documents stay on every host; on the bad host those that break a soft rule go
    assert kept == {("bad", False): 10, ("fine", False): 95, ("fine", True): 5}


def test_host_verdict_follows_the_other_hosts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    soft, hard = good + " " + "# " * 30, "too short"
    n = {"worse": (75, 25), "usual": (95, 5), "usual too": (96, 4), "small": (3, 1)}
    rows = [(s, t) for s, (a, b) in n.items() for t in [good] * (5 * a) + [soft] * (5 * b - 2) + [hard] * 2]
    out = quality.judged(quality.measured(spark.createDataFrame(rows, "source string, text string"))).collect()
    rate = {r.source: r.host_rate for r in out}
    assert rate["worse"] < quality.HOST_LIMIT
    kept = collections.Counter((r.source, r.text) for r in out if r.kept)
    # every clean text stays; what breaks a soft rule goes on the host that is worse than the others, and only there
    assert {s: kept[s, good] for s in n} == {s: 5 * a for s, (a, _) in n.items()}
    assert {s: kept[s, soft] for s in n} == {"worse": 0, "usual": 23, "usual too": 18, "small": 3}
    assert not any(kept[s, hard] for s in n)


def test_equal_hosts_are_not_bad(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(f"h{i % 5}", good + " " + "# " * 30 if i % 20 < 5 else good) for i in range(400)]
    out = quality.judged(quality.measured(spark.createDataFrame(rows, "source string, text string"))).collect()
    assert all(r.kept for r in out)


def test_wide_limits_hold_on_every_host(spark):
    good = " ".join(f"w{i}" for i in range(60))
    symbols, lines = good + " " + "# " * 60, "the same line again\n" * 5 + good
    rows = [(f"h{i % 4}", good) for i in range(400)] + [(f"h{i % 4}", t) for i in range(8) for t in (symbols, lines)]
    out = quality.judged(quality.measured(spark.createDataFrame(rows, "source string, text string"))).collect()
    assert {r.kept for r in out if r.text == good} == {True}
    assert {r.kept for r in out if r.text != good} == {False} and not any(r.base_failed for r in out)


@pytest.mark.parametrize("size", [10, 100_000])
def test_equal_rates_have_equal_verdicts(spark, size):
    def bad(rates):
        rows = [(f"h{i}", size, int(size * r)) for i, r in enumerate(rates)]
        return [r.bad for r in quality.rated(spark.createDataFrame(rows, "_host string, n_docs long, n_failed long")).orderBy(F.expr("int(substr(_host, 2))")).collect()]

    assert bad([0.1] * 6 + [0.6] * 6) == [False] * 6 + [True] * 6
    assert not any(bad([0.1 + i / 1000 for i in range(20)]))
    assert not any(bad([0.2] * 20)) and all(bad([0.7] * 20))


def test_internal_names_are_free(spark):
    good = " ".join(f"w{i}" for i in range(60))
    names = {n: F.lit(f"own {n}") for n in ("_host", "_bad", "_failed", "bad", "narrow", "wide", "failed", "rate", "hash", "_hash", "_source", "limit", "passes", "size_")}
    rows = spark.createDataFrame([(1, good, "a"), (2, "x", None), (3, None, "b")], "doc_id long, text string, source string").withColumns(names)
    for out in (quality.judged(quality.measured(rows)), mixing.mix(rows)):
        got = out.collect()
        assert len(got) == 3 and all(r[n] == f"own {n}" for r in got for n in names)


def test_texts_without_words_are_not_copied_beyond_the_bound(spark):
    rows = [(i, "a b c", "s1") for i in range(4)] + [(10 + i, "", "s1") for i in range(200)] + [(900 + i, "x " * 50, "s2") for i in range(9)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(9, 1))
    assert {r.copies for r in out.filter("size = 0").collect()} <= {0, 1, 2}
    assert {r.copies for r in out.filter("source = 's1' and size > 0").collect()} == {2}


def test_prior_shrinks():
    mean, strength = quality.prior(100, 50, 2, 45.0 * 45 / 50 + 5.0 * 5 / 50)
    assert mean == 0.5 and strength >= 1
    assert quality.prior(0, 0, 0, 0.0) == (0.0, None)
    assert quality.prior(100, 50, 2, 25.0 * 25 / 50 * 2)[1] is None


def test_mixing(docs, doc_rows, no_docs):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert len(rows) == len(doc_rows)
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "", r.copies)
    assert sorted(map(key, rows), key=str) == sorted(map(key, again), key=str)
    size, taken, longest, target = collections.Counter(), collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert r.size == len(words_of(r.text)) and 0 <= r.copies <= 2
        size[r.source] += r.size
        taken[r.source] += r.size * r.copies
        longest[r.source] = max(longest[r.source], r.size)
        target[r.source] = r.target
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, open_ = dict.fromkeys(names, 0.0), set(names)
    while open_:  # share by weight, stop at twice the size, share the rest again
        rest = 1.5 * sum(size.values()) - sum(want[s] for s in names if s not in open_)
        shares = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if shares[s] > 2 * size[s]}
        if not over:
            want.update(shares)
            break
        want.update({s: 2.0 * size[s] for s in over})
        open_ -= over
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= longest[s]
    assert mixing.mix(no_docs).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_classes(docs, doc_rows, no_docs):
    got = collections.Counter((r.doc_id, r.hex, r.component) for r in
                              simhash.near_duplicates(docs).withColumn("hex", simhash.hex16("fingerprint")).collect())
    prints = [brute_fingerprint(r[1]) for r in doc_rows]
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(doc_rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = collections.Counter((r[0], f"{prints[i]:016x}", least.get(root(i))) for i, r in enumerate(doc_rows))
    assert got == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_every_pair_within_the_radius_is_linked(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40)
    values = set(centres.tolist())
    for c in centres.tolist():
        for n in (1, 2, 3, 4, 5):
            bits = rng.choice(63, n, replace=False)
            values.add(c ^ sum(1 << int(b) for b in bits))
    values = sorted(values)
    prints = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "fingerprint long, node long")
    got = {r.fingerprint: r.component for r in simhash.classes(prints, "node").collect()}
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, v in enumerate(values):
        least.setdefault(root(v), i)
    assert got == {v: least[root(v)] for v in values}


def test_crowded_keys_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    values = [1 << i for i in range(40)] + [(1 << 50) | (1 << 51) | (1 << 52) | (1 << 53) | (1 << 54)]
    prints = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "fingerprint long, node long")
    got = {r.fingerprint: r.component for r in simhash.classes(prints, "node").collect()}
    assert got == {v: 0 if i < 40 else 40 for i, v in enumerate(values)}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keys_and_pieces_are_not_broadcast(spark, monkeypatch):
    """The planner takes the ten keys of a fingerprint for one row, and the driver would collect them all."""
    plans, stored = [], simhash.stored

    def noted(df, name):
        plans.append(df)
        return stored(df, name)

    monkeypatch.setattr(simhash, "stored", noted)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "10m")
    try:
        prints = stored(spark.createDataFrame([(1, 0), (2, 1)], "fingerprint long, node long"), "prints")
        texts = [(i, p[1 + k]) for i, p in enumerate(pairs_at([0.9] * 5, 150, 23)) for k in (0, 1)]
        rows = spark.createDataFrame(texts, "id long, text string").withColumn("digest", F.md5("text"))
        distinct = stored(simhash.banded(rows, "text", 5).dropDuplicates(["node"]), "distinct")
        edges = simhash._similar_links(distinct, rows.select("digest", "text"), 5, 0.8)
        found = [df._jdf.queryExecution().executedPlan().toString() for df in (simhash.links(prints), *plans, edges)]
        assert edges.count() == 5
    finally:
        spark.conf.set(threshold, before)
    assert sum("SortMergeJoin [key#" in p or "SortMergeJoin [choice#" in p for p in found) >= 2
    assert not [p for p in found if re.search(r"BroadcastHashJoin \[(choice|key)#", p)]
    assert "SortMergeJoin [node#" in found[-1] and "Broadcast" not in found[-1]


def test_near_copies_keep_the_first(docs, doc_rows, no_docs):
    rows = simhash.first_of_near_copies(docs).collect()
    kept = collections.Counter(r.doc_id for r in rows)
    assert max(kept.values()) == 1
    assert 0 in kept and not {90, 93} & set(kept)  # copies of the first text
    assert 12 in kept  # repeated rows leave one
    assert set(range(0, 90, 3)) <= set(kept)  # different texts stay
    assert simhash.first_of_near_copies(no_docs).count() == 0


def test_near_copies_meet_by_simhash(spark):
    """Without a band in common, close fingerprints alone bring similar texts together, and only similar ones are linked."""
    long = [f"w{i}" for i in range(2000)]
    texts = {1: " ".join(long), 2: " ".join(long[:-1] + ["other"]), 3: " ".join(reversed(long)), 4: "", 5: None, 6: "one two"}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string").withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    sets = simhash.banded(rows, "text", 5).withColumn("keys", F.array().cast("array<bigint>")).dropDuplicates(["node"])
    a, b = (s.fingerprint for s in sets.filter("id in (1, 2)").collect())
    assert (a ^ b).bit_count() <= 3
    nodes = {bytes(r.node): r.id for r in sets.filter("id is not null").collect()}
    distinct = sets.select("node", "size", "fingerprint", "digest", "keys")
    edges = simhash._similar_links(distinct, rows.select("digest", "text"), 5, 0.8).collect()
    assert [{nodes[bytes(e.a)], nodes[bytes(e.b)]} for e in edges] == [{1, 2}]


def test_near_copies_catch_similar_texts(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for _ in range(60):
        words = [f"v{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((n, " ".join(words)))
        words[int(rng.integers(200))] = "changed"
        words[int(rng.integers(200))] = "changed"
        rows.append((n + 1, " ".join(words)))  # about 190 of 210 shingles shared
        n += 2
    kept = {r.doc_id for r in simhash.first_of_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {r for r in range(0, n, 2)} <= kept and len(kept) <= 60 + 3


def pairs_at(similarities, words, seed):
    """(similarity counted out, text, text) of pairs of texts that differ in a few words."""
    rng = np.random.default_rng(seed)
    out = []
    for similarity in similarities:
        a = [f"v{x}" for x in rng.integers(0, 1 << 40, words)]
        b = list(a)
        # the words at one end go, so that the share is the one asked for
        gone = round((words - 4) * (1 - similarity) / (1 + similarity))
        b[:gone] = [f"u{x}" for x in rng.integers(0, 1 << 40, gone)]
        sets = [set(simhash.shingle_hashes(" ".join(t).encode().split(), 5).tolist()) for t in (a, b)]
        out.append((len(sets[0] & sets[1]) / len(sets[0] | sets[1]), " ".join(a), " ".join(b)))
    return out


def linked(spark, pairs):
    """Whether one text of each pair is left."""
    rows = [(2 * i + k, p[1 + k]) for i, p in enumerate(pairs) for k in (0, 1)]
    kept = {r.doc_id for r in simhash.first_of_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {2 * i for i in range(len(pairs))} <= kept
    return [2 * i + 1 not in kept for i in range(len(pairs))]


def test_every_pair_from_the_similarity_on_is_linked(spark):
    pairs = pairs_at([0.80 + 0.1 * i / 600 for i in range(600)], 150, 11)
    near = [p for p in pairs if 0.8 <= p[0] <= 0.9]
    assert len(near) > 500 and sum(p[0] < 0.82 for p in near) > 80
    assert all(linked(spark, near))


def test_bands_share_as_their_formula_says():
    pairs = pairs_at([0.6] * 300, 400, 13)
    shared = [len(np.intersect1d(*[simhash.band_keys(simhash.shingle_set(t.encode(), 5)) for t in p[1:]])) / simhash.BANDS for p in pairs]
    assert abs(np.mean(shared) - np.mean([p[0] ** simhash.ROWS for p in pairs])) < 0.01


def test_no_pair_below_the_similarity_is_linked(spark):
    below = [p for p in pairs_at([0.6 + 0.2 * i / 300 for i in range(300)], 150, 17) if p[0] < 0.8]
    assert len(below) > 280 and sum(p[0] >= 0.75 for p in below) > 50
    assert not any(linked(spark, below))


def test_a_template_below_the_similarity_chains_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(19)
    template = [f"t{x}" for x in range(120)]
    texts = [" ".join(template + [f"o{x}" for x in rng.integers(0, 1 << 40, 25)]) for _ in range(40)]  # 0.7 to each other
    texts += [texts[k] + " and one more" for k in range(10)]  # near copies of ten of them
    rows = list(enumerate(texts))
    kept = {r.doc_id for r in simhash.first_of_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(40))


def test_forest_tries_every_link():
    sets = [np.unique(np.array(x, np.uint64)) for x in ([1, 2, 3, 4, 5], [2, 3, 4, 5], [9, 10], [2, 3, 4, 5, 6], [9, 10, 11, 12], [3, 4, 5, 6])]
    found = simhash.similar_forest(sets, 0.8)
    assert {frozenset(x) for x in found} == {frozenset((0, i)) for i in (1, 3, 5)}


def brute_removed(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first = {}
    for i in order:
        words = words_of(rows[i][1])
        for s in range(len(words) - 19):
            place = (rows[i][0] is None, rows[i][0] or 0, s)
            window = tuple(words[s : s + 20])
            if window not in first or place < first[window]:
                first[window] = place
    out = []
    for doc_id, text, *_ in rows:
        words = words_of(text)
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            if first[tuple(words[s : s + 20])] < (doc_id is None, doc_id or 0, s):
                gone[s : s + 20] = [True] * 20
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def test_substrings(docs, doc_rows, no_docs):
    got = substrings.without_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.sha) for r in got) == brute_removed(doc_rows)
    assert substrings.without_repeats(no_docs).count() == 0


def test_substrings_in_many_batches_and_crowds(docs, doc_rows, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", 6000)
    monkeypatch.setattr(substrings, "SHARD_KEYS", 2000)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 1000)
    monkeypatch.setattr(substrings, "CROWD", 2)
    got = substrings.without_repeats(docs.select("doc_id", "text")).withColumn("sha", F.sha2("kept", 256)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.sha) for r in got) == brute_removed(doc_rows)


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = [b"one two  three", b"", b"a-word-over-many-pieces two", b" one"]
    whole = substrings.Words(texts).hashes
    assert whole[0] == whole[-1] and whole[1] == whole[4] and len(set(whole.tolist())) == 4
    for size in (1, 2, 7):
        monkeypatch.setattr(substrings, "HASHED_BYTES", size)
        assert (substrings.Words(texts).hashes == whole).all()


def test_segments_do_not_depend_on_runs(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [b" ".join(rng.choice([b"a", b"b", b"c"], n).tolist()) for n in (0, 19, 20, 90, 0, 3, 400, 21, 0)]
    words = substrings.Words(texts)
    whole = substrings.segments(words)
    assert whole[1].sum() == 1 + 71 + 381 + 2
    for size in (1, 25, 120):
        monkeypatch.setattr(substrings, "RUN_WORDS", size)
        assert len(list(words.runs(size))) > 1
        assert all((x == y).all() for x, y in zip(substrings.segments(words), whole, strict=True))
    assert [len(x) for x in substrings.segments(substrings.Words([]))] == [0, 0, 0]


def test_minimizers_of_a_batch_in_bounded_memory():
    rng = np.random.default_rng(3)
    texts = [b" ".join(rng.choice([b"alpha", b"beta", b"gamma", b"delta"], 5000).tolist()).decode() for _ in range(100)]
    docs = pa.table({"id": pa.array(range(100), pa.int64()), "text": texts})
    tracemalloc.start()
    try:
        substrings._minimizers(docs, 0, "text")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 * sum(map(len, texts))


def test_fm_index_finds_repeats():
    from trustlake.llm.fmindex import FmIndex

    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 4, 300), 0)
    index = FmIndex(text)
    ends = np.arange(8, 301)
    matched, lo, hi = index.matches(ends, 8)
    places = collections.defaultdict(list)
    for e in ends:
        places[tuple(text[e - 8 : e])].append(int(e) - 8)
    first = index.first_place(lo[matched == 8], hi[matched == 8])
    assert {int(e): int(f) for e, f in zip(ends[matched == 8], first)} == {
        p + 8: v[0] for v in places.values() if len(v) > 1 for p in v
    }
