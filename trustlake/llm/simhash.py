"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, connected classes.

``fingerprints`` gives every text a 64-bit SimHash of its word shingles. Two fingerprints that differ in at most
``radius`` of ``blocks`` blocks agree on ``blocks - radius`` of them, so they share a key for at least one choice
of that many blocks; they are joined on these keys and their distance is checked bit by bit. Nothing is
approximated: every pair within the radius meets.

Equal fingerprints are folded to one row first, so copies cost one row. Where a key holds many different
fingerprints, they are dealt out by hash into chunks and every pair of chunks is one bounded piece of work; a
piece gives a spanning forest of its links, not all of its pairs. Classes are the connected components.

Defined cases: a null or wordless text has fingerprint zero, which links like any other; a text with fewer words
than a shingle is one shingle; repeated rows have equal fingerprints and share a class; a null id is passed
through and is never the smallest of its class unless the class has no other id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlake.llm.common import adding, bytes_or_empty, merged, named_back, renamed, stored
from trustlake.llm.graph import components

BITS = 64
#: Hashes whose bits are counted at a time, and fingerprints in one chunk of a crowded key.
COUNTED, CHUNK = 1 << 16, 4096


def shingle_hashes(words: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words joined by one space, repeats included, as unsigned numbers."""
    from xxhash import xxh64_intdigest as xxh64

    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((xxh64(line[a:b], seed) for a, b in spans), np.uint64, len(words) - k + 1)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; none: zero."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """``df`` with ``out``, the SimHash of the whole text (A-Z lowered) as a signed long."""

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            rows = [signed(simhash(shingle_hashes(t.lower().split(), shingle))) for t in bytes_or_empty(batch.column(text))]
            yield batch, [pa.array(rows, pa.int64())]

    return adding(df, T.StructType([T.StructField(out, T.LongType(), False)]), columns)


def block_masks(radius: int, blocks: int) -> list[int]:
    """Signed masks of all choices of ``blocks - radius`` blocks; a pair within ``radius`` agrees under one of them."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    of = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [signed(sum(choice)) for choice in combinations(of, blocks - radius)]


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for the links within ``radius``: members of one connected part get the same root."""
    rest, members, roots = np.unique(values), [], []
    while len(rest):
        root, rest = rest[0], rest[1:]
        stack = [root]
        while stack and len(rest):
            near = np.bitwise_count(rest ^ stack.pop()) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                members.append(found)
                roots.append(np.full(len(found), root))
                stack.extend(found)
    if not members:
        return np.empty(0, values.dtype), np.empty(0, values.dtype)
    return np.concatenate(members), np.concatenate(roots)


def links(prints: DataFrame, out: str = "fingerprint", radius: int = 3, blocks: int = 5) -> DataFrame:
    """(a, b): edges between distinct fingerprints that span the links within ``radius``.

    ``prints`` has one row for each fingerprint. More ``blocks`` make longer keys, so fewer chance meetings,
    and more rows for each fingerprint.
    """
    value = F.col(out)
    keyed = prints.select(
        value.alias("value"),
        F.posexplode(F.array(*[value.bitwiseAND(F.lit(m)) for m in block_masks(radius, blocks)])).alias("choice", "key"),
    )
    crowds = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    pieces = (
        merged(keyed, crowds, ["choice", "key"])
        .withColumn("chunks", F.ceil(F.col("n") / CHUNK))
        .withColumn("own", F.pmod(F.xxhash64("value"), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .groupBy("choice", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        .agg(F.collect_list("value").alias("values"))
        .select("values")
    )

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [forest(v.values.to_numpy().view(np.uint64), radius) for v in batch.column(0)]
            for_each = [np.concatenate([x[i] for x in found]).view(np.int64) if found else np.empty(0, np.int64) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in for_each], names=["a", "b"])

    return pieces.mapInArrow(span, "a long, b long").distinct()


def classes(prints: DataFrame, node: str, out: str = "fingerprint", radius: int = 3, blocks: int = 5) -> DataFrame:
    """(fingerprint, component): the smallest ``node`` of the class of each distinct fingerprint in ``prints``."""
    distinct = stored(prints.groupBy(out).agg(F.min(node).alias("_least")), "fingerprints")
    hooked = components(links(distinct, out, radius, blocks)).withColumnRenamed("node", out)
    rooted = distinct.join(hooked, out, "left").withColumn("_root", F.coalesce("component", out)).drop("component")
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component"))
    return rooted.join(least, "_root").select(out, "component")


def near_duplicates(
    df: DataFrame, node: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, blocks: int = 5
) -> DataFrame:
    """(``node``, fingerprint, component) of every row of ``df``; ``component`` is the smallest ``node`` reachable."""
    prints = stored(fingerprints(df.select(node, text), text, "fingerprint", shingle).drop(text), "prints")
    return prints.join(classes(prints, node, "fingerprint", radius, blocks), "fingerprint").select(node, "fingerprint", "component")


def hex16(value: str | Column) -> Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# --- near copies by shingle similarity ---------------------------------------------------------------------------

#: Minima of a band, bands of a text: a pair at 0.8 shares no band with probability (1 - 0.8 ** 5) ** 40, about 1e-7.
ROWS, BANDS = 5, 40
#: Shingles in one chunk of a crowded band, and hashes whose minima are taken at a time.
CHUNK_SHINGLES, MINIMA = 1 << 20, 1 << 9

_draw = np.random.default_rng(42)
_FACTORS = _draw.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIXERS = _draw.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of the word shingles of the whole text (A-Z lowered), in order."""
    return np.unique(shingle_hashes(text.lower().split(), shingle))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A number for each band of minima of a set of hashes; an empty set has none."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), MINIMA):
        part = hashes[at : at + MINIMA]
        np.minimum(least, (_FACTORS[:, None] * part).min(axis=1), out=least)
    # numbers of different bands differ, as each has its own factors
    x = (least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(29))) * _MIXERS
    x = (x ^ (x >> np.uint64(32))).sum(axis=1, dtype=np.uint64)
    return x.view(np.int64)


def banded(df: DataFrame, text: str, shingle: int) -> DataFrame:
    """``df`` with node (a 128-bit digest of the set of shingles), its size, its SimHash, and the keys of its bands."""

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for t in bytes_or_empty(batch.column(text)):
                hashes = shingle_set(t, shingle)
                nodes.append(xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                prints.append(signed(simhash(hashes)))
                keys.append(band_keys(hashes))
            numbers = [pa.array(x, pa.int64()) for x in (sizes, prints)]
            yield batch, [pa.array(nodes, pa.binary()), *numbers, pa.array(keys, pa.list_(pa.int64()))]

    added = [("node", T.BinaryType()), ("size", T.LongType()), ("fingerprint", T.LongType()), ("keys", T.ArrayType(T.LongType()))]
    return adding(df, T.StructType([T.StructField(n, t) for n, t in added]), columns)


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(member, root) that span the links of Jaccard ``similarity`` or more between the sets, every one counted out."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(ids.max(initial=0) + 1, bool)
    ends = np.cumsum(sizes)
    of = [ids[e - n : e] for e, n in zip(ends, sizes)]
    rest, found = np.arange(len(sets)), []
    flat = ids
    while len(rest) > 1:
        root = rest[0]
        stack, rest, flat = [root], rest[1:], flat[sizes[root] :]
        while stack and len(rest):
            at = stack.pop()
            marked[of[at]] = True
            starts = np.cumsum(sizes[rest]) - sizes[rest]
            both = np.add.reduceat(marked[flat], starts, dtype=np.int64)
            marked[of[at]] = False
            near = both >= similarity * (sizes[at] + sizes[rest] - both)
            if near.any():
                found += [(int(i), int(root)) for i in rest[near]]
                stack.extend(rest[near])
                rest, flat = rest[~near], flat[np.repeat(~near, sizes[rest])]
    return found


def _similar_links(distinct: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): edges that span the links between the sets ``distinct`` (node, size, fingerprint, digest, keys).

    Sets whose fingerprints are connected within the radius (``classes``: pigeonhole blocks, Hamming check) meet in a piece,
    and sets that share a band do; crowded keys are dealt out in chunks by hash, and every pair of chunks
    is a piece. Pieces of the same sets are one. The sets come to the pieces whole, made again from ``texts``
    (digest, text), and every link is counted out there.
    """
    worded = distinct.filter("size > 0")
    close = worded.join(classes(worded, "node"), "fingerprint").select("node", "size", F.xxhash64("component").alias("key"))
    keyed = close.unionByName(worded.select("node", "size", F.explode("keys").alias("key")))
    crowds = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("sum")).filter("n > 1")
    dealt = (
        merged(keyed, crowds, "key")
        .withColumn("chunks", F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("sum") / CHUNK_SHINGLES)))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .groupBy("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        .agg(F.array_sort(F.collect_list("node")).alias("nodes"))
        .filter(F.size("nodes") > 1)
        .select("nodes")
        .distinct()
    )
    members = stored(
        dealt.withColumn("piece", F.unhex(F.md5(F.array_join(F.transform("nodes", F.hex), ""))))
        .select("piece", F.explode("nodes").alias("node")),
        "pieces",
    )
    wanted = stored(distinct.join(members.select("node").distinct(), "node", "left_semi").select("node", "digest"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            yield batch, [pa.array([shingle_set(t, shingle).tobytes() for t in bytes_or_empty(batch.column("text"))], pa.binary())]

    found = adding(texts.join(wanted, "digest"), T.StructType([T.StructField("set", T.BinaryType())]), sets)
    whole = stored(found.select("node", "set").dropDuplicates(["node"]), "sets")

    def span(piece: pa.Table) -> pa.Table:
        nodes = piece.column("node").to_pylist()
        arrays = [np.frombuffer(s, np.uint64) for s in piece.column("set").to_pylist()]
        edges = similar_forest(arrays, similarity)
        return pa.table({"a": pa.array([nodes[i] for i, _ in edges], pa.binary()), "b": pa.array([nodes[j] for _, j in edges], pa.binary())})

    return merged(members, whole, "node").groupBy("piece").applyInArrow(span, "a binary, b binary").distinct()


def first_of_near_copies(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """The rows of ``df`` without near copies: of each class the row with the smallest id, null last.

    Texts are linked if the Jaccard similarity of their sets of word shingles, counted out, is ``similarity`` or
    more; classes are the connected components. Pairs are found by SimHash, as in ``near_duplicates``, and, since similar
    sets often differ in more bits than its radius, by bands of minima too (see ``BANDS``). If rows of a
    class share the smallest id, the text with the smallest MD5 stays, and of wholly repeated rows one.
    """
    own, names = renamed(df)
    doc_id, text = names[doc_id], names[text]
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    rows = own.select(F.col(doc_id).alias("id"), digest.alias("digest"), F.col(text).alias("text"))
    prints = stored(banded(rows, "text", shingle).drop("text"), "prints")
    distinct = stored(
        prints.groupBy("node").agg(F.min("digest").alias("digest"), *[F.first(c).alias(c) for c in ("size", "fingerprint", "keys")]),
        "distinct-sets",
    )
    edges = _similar_links(distinct, rows.select("digest", "text"), shingle, similarity)
    of = components(edges)
    kept = (
        prints.select("id", "digest", "node")
        .join(of, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("class"))
        .agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "digest")).alias("first"))
        .select(_row_key(F.col("first.id"), F.col("first.digest")).alias("_row"))
    )
    # one key for the join and for repeated rows, so the texts are shuffled once
    out = own.withColumn("_row", _row_key(F.col(doc_id), digest)).join(kept, "_row", "left_semi").dropDuplicates(["_row"])
    return named_back(out, names, [])


def _row_key(doc_id: Column, digest: Column) -> Column:
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), digest)
