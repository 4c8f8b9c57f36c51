"""Removal of word sequences that occur earlier, with an FM-index per shard.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window covers it whose word sequence
also starts earlier: in a document with a smaller id, or earlier in the same document. Windows are judged on the
input. The result is exact; hashes only decide which texts meet.

1. Every window has a minimizer: of its ``WINDOW - GRAM + 1`` runs of ``GRAM`` words the one with the smallest
   hash, leftmost if equal. It depends on the window's words only, so equal windows have equal minimizers. The
   consecutive windows with one minimizer at one place are a segment, so a text of n words has about n / 7.
2. Documents are dealt into batches of bounded size by hash. Each batch sends its distinct minimizers with counts
   to shards by minimizer, which answer to the batches those that occur more than once in all.
3. Only the segments with such a minimizer are sent on, with their words, one row for each distinct segment of a
   batch and the place where it first starts there. Segments go to shards by minimizer. Where a minimizer occurs
   more than ``CROWD`` times, its windows are sent singly and go by the hash of the whole window, so a sentence
   that a third of all documents share is spread over the shards, and is one row a batch.
4. Each shard indexes its distinct segments in an FM-index and streams their windows through backward search. The
   matching statistics end where a sequence is found in one place only; the windows whose whole length has
   several places are reported with the first of them. A segment gets back a mask of the windows that start
   first where the batch has them.
5. The batch takes all other occurrences away.

Steps 2 to 5 shuffle the documents once, by batch; the three readers of that exchange share it.

Defined cases: a null or empty text has no words; a text of fewer words than a window loses nothing; rows with
the same id are one document, so at equal starts neither is earlier; a null id comes after all others; all other
columns are passed through, and columns with the names of added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trustlake.llm.common import bytes_or_empty, named_back, renamed, stored
from trustlake.llm.fmindex import FmIndex
from trustlake.llm.importance import ranked

WINDOW, GRAM = 20, 8
#: Text bytes in a batch of documents, words in a shard of the index, minimizers in a shard of counts.
BATCH_BYTES, SHARD_WORDS, SHARD_KEYS = 8 << 20, 400_000, 400_000
#: A minimizer with more occurrences than this sends its windows singly.
CROWD = 500
#: Bytes whose prefix sums are held at a time; they take eight bytes a byte, several times over.
HASHED_BYTES = 1 << 18
#: Words whose minimizers are found at a time; a longer text is taken whole.
RUN_WORDS = 1 << 17
#: Odd multipliers modulo 2**64 for the hashes of bytes and of words.
BYTE, WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
ADDED = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
)
LAST = np.iinfo(np.int64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: the difference of two prefix sums, moved to the front by the inverse power.

    The sums go through ``data`` piece by piece and are kept at the words' ends only; a word may lie in many pieces.
    """
    inverse = pow(int(BYTE), -1, 1 << 64)
    longest = min(len(data), HASHED_BYTES)
    powers, inverses = _powers(BYTE, longest), _powers(np.uint64(inverse), longest)
    before, after, back = (np.empty(len(starts), np.uint64) for _ in range(3))
    total = np.zeros(1, np.uint64)
    for lo in range(0, len(data), HASHED_BYTES):
        piece = data[lo : lo + HASHED_BYTES]
        terms = (piece + np.uint64(1)) * powers[: len(piece)] * np.uint64(pow(int(BYTE), lo, 1 << 64))
        sums = np.cumsum(np.concatenate((total, terms)), dtype=np.uint64)
        total = sums[-1:]
        a, b = np.searchsorted(starts, (lo, lo + len(piece)))
        at = starts[a:b] - lo
        before[a:b], back[a:b] = sums[at], inverses[at] * np.uint64(pow(inverse, lo, 1 << 64))
        a, b = np.searchsorted(ends, (lo + 1, lo + len(piece) + 1))
        after[a:b] = sums[ends[a:b] - lo]
    return _mixed((after - before) * back)


class Words:
    """The words of a list of texts as byte positions, with a hash of each and the number of its text."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)  # white space, so no word reaches over
        data = np.frombuffer(self.data, np.uint8)
        blank = np.ones(len(data) + 2, bool)
        blank[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
        self.starts = np.flatnonzero(blank[:-2] & ~blank[1:-1])
        self.ends = np.flatnonzero(~blank[1:-1] & blank[2:]) + 1
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.cumsum(lengths + 1) - lengths - 1
        self.first = np.searchsorted(self.starts, np.append(offsets, len(data) + 1))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hashes = _word_hashes(data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def runs(self, size: int) -> Iterator[tuple[int, int]]:
        """(start, stop) of whole texts with about ``size`` words together."""
        at = 0
        while at < len(self.first) - 1:
            after = max(at + 1, int(np.searchsorted(self.first, self.first[at] + size, side="right")) - 1)
            yield int(self.first[at]), int(self.first[after])
            at = after

    def bytes_of(self, start: int, stop: int) -> bytes:
        """The words start .. stop joined by one space."""
        return b" ".join(self.data[self.starts[start] : self.ends[stop - 1]].split())

    def run_hash(self, start: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros(len(start), np.uint64)
        for j in range(n):
            total = total * WORD + self.hashes[start + j]
        return _mixed(total)


def segments(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimizer) of the segments, in the order of the texts."""
    none = np.empty(0, np.int64)
    found = [(none, none, none), *(_segments_between(words, a, b) for a, b in words.runs(RUN_WORDS) if b - a >= WINDOW)]
    first, count, key = (np.concatenate(x) for x in zip(*found))
    return first, count, key


def _segments_between(words: Words, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments of the words a .. b of whole texts."""
    value = words.run_hash(np.arange(a, b - GRAM + 1), GRAM)
    place = np.arange(len(value))
    width, wanted = 1, WINDOW - GRAM + 1
    while width < wanted:
        step = min(width, wanted - width)
        right = value[step:] < value[:-step]  # the left one if equal
        value, place = np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])
        width += step
    windows = np.flatnonzero(words.doc[a : b - WINDOW + 1] == words.doc[a + WINDOW - 1 : b])
    value, place = value[windows], place[windows]
    cuts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.empty(0, np.int64)
    return a + windows[cuts], np.diff(np.append(cuts, len(windows))), value[cuts].view(np.int64)


def _ordered(docs: pa.Table, doc_id: str, text: str) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """The batch in the order of its ids, with ids and texts; a null id is the largest."""
    ids = docs.column(doc_id).combine_chunks().cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
    texts = bytes_or_empty(docs.column(text).combine_chunks())
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return docs.take(pa.array(order, pa.int64())), ids[order], [texts[i] for i in order]


def _minimizers(docs: pa.Table, batch: int, text: str) -> pa.Table:
    texts = bytes_or_empty(docs.column(text).combine_chunks())
    keys, counts = np.unique(segments(Words(texts))[2], return_counts=True)
    return pa.table({"batch": np.full(len(keys), batch, np.int64), "key": keys, "n": counts.astype(np.int64)})


def _repeated(rows: pa.Table) -> pa.Table:
    """Of a shard of counts, the (batch, key) whose key occurs more than once in all; value 1 if it is crowded."""
    batch, key, n = (rows.column(c).to_numpy() for c in ("batch", "key", "n"))
    _, inverse = np.unique(key, return_inverse=True)
    total = np.bincount(inverse, weights=n)[inverse] if len(key) else np.empty(0)
    several = total > 1
    crowded = (total[several] > CROWD).astype(np.int64)
    return pa.table({"batch": batch[several], "kind": np.zeros(len(crowded), np.int64), "key": key[several], "value": crowded})


class Candidates:
    """The segments of a batch that may occur elsewhere, distinct by route and words, and where they start."""

    def __init__(self, words: Words, ids: np.ndarray, keys: np.ndarray, crowded: np.ndarray):
        first, count, key = segments(words)
        order = np.argsort(keys)
        keys, crowded = keys[order], crowded[order]
        at = np.searchsorted(keys, key)
        known = np.zeros(len(key), bool)
        known[at < len(keys)] = keys[at[at < len(keys)]] == key[at < len(keys)]
        alone = np.zeros(len(key), bool)
        alone[known] = crowded[at[known]] == 1
        plain = known & ~alone
        # the windows of crowded segments, one by one
        n = count[alone]
        single = np.repeat(first[alone], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.concatenate((first[plain], single))
        windows = np.concatenate((count[plain], np.ones(len(single), np.int64)))
        route = np.concatenate((key[plain], words.run_hash(single, WINDOW).view(np.int64)))
        order = np.argsort(start, kind="stable")
        self.start, self.windows, route = start[order], windows[order], route[order]
        doc = words.doc[self.start] if len(self.start) else np.empty(0, np.int64)
        self.id, self.at = ids[doc], self.start - words.first[doc]
        self.entry = np.empty(len(self.start), np.int64)
        self.leads: list[int] = []  # the first occurrence of each distinct one
        self.bodies: list[bytes] = []
        found: dict[tuple[int, bytes], int] = {}
        for i, (s, w, r) in enumerate(zip(self.start.tolist(), self.windows.tolist(), route.tolist())):
            body = words.bytes_of(s, s + w + WINDOW - 1)
            entry = found.setdefault((r, body), len(self.bodies))
            if entry == len(self.bodies):
                self.bodies.append(body)
                self.leads.append(i)
            self.entry[i] = entry
        self.route = route[self.leads] if self.leads else np.empty(0, np.int64)


def _candidates(docs: pa.Table, answers: pa.Table, doc_id: str, text: str):
    docs, ids, texts = _ordered(docs, doc_id, text)
    kind, key, value = (answers.column(c).to_numpy() for c in ("kind", "key", "value"))
    words = Words(texts)
    found = Candidates(words, ids, key[kind == 0], value[kind == 0])
    masks = np.zeros(len(found.bodies), np.int64)
    masks[key[kind == 1]] = value[kind == 1]
    return docs, texts, words, found, masks


def _first_starts(rows: pa.Table) -> pa.Table:
    """Of a shard of segments: for each row the mask of its windows that start nowhere earlier."""
    bodies = rows.column("body").to_pylist()
    ids, starts = rows.column("id").to_numpy(), rows.column("at").to_numpy()
    earliest: dict[bytes, tuple[int, int]] = {}
    for body, place in zip(bodies, zip(ids.tolist(), starts.tolist())):
        known = earliest.get(body)
        if known is None or place < known:
            earliest[body] = place
    texts = sorted(earliest, key=earliest.__getitem__)
    number: dict[bytes, int] = {}
    lengths = np.empty(len(texts), np.int64)
    symbols: list[int] = []
    for i, body in enumerate(texts):
        words = body.split()
        lengths[i] = len(words)
        symbols.extend(number.setdefault(w, len(number) + 1) for w in words)
        symbols.append(0)
    text = np.array(symbols, np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    counts = lengths - WINDOW + 1
    of = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    index = FmIndex(text)
    matched, lo, hi = index.matches(begin[of] + offset + WINDOW, WINDOW)
    several = matched == WINDOW
    place = begin[of] + offset
    place[several] = index.first_place(lo[several], hi[several])
    # the texts are ordered by their first starts, so the smallest text position is the earliest start
    at = np.searchsorted(begin, place, side="right") - 1
    first_id = np.array([earliest[t][0] for t in texts], np.int64)
    first_start = np.array([earliest[t][1] for t in texts], np.int64)
    window_id, window_start = first_id[at], first_start[at] + place - begin[at]
    where = {body: i for i, body in enumerate(texts)}
    row_text = np.fromiter(map(where.__getitem__, bodies), np.int64, len(bodies))
    window_from = np.cumsum(counts) - counts
    mask = np.zeros(len(bodies), np.int64)
    for j in range(int(counts.max())):
        has = counts[row_text] > j
        w = window_from[row_text[has]] + j
        same = (window_id[w] == ids[has]) & (window_start[w] == starts[has] + j)
        mask[has] |= same.astype(np.int64) << j
    return pa.table({"batch": rows.column("batch"), "kind": np.ones(len(mask), np.int64), "key": rows.column("entry"), "value": mask})


def _without(docs: pa.Table, answers: pa.Table, doc_id: str, text: str, schema: pa.Schema) -> pa.Table:
    """The batch with what is left of each text."""
    docs, texts, words, found, masks = _candidates(docs, answers, doc_id, text)
    step = np.zeros(len(words) + 1, np.int64)
    if len(found.start):
        lead = np.array(found.leads, np.int64)[found.entry]
        leads = (found.id == found.id[lead]) & (found.at == found.at[lead])
        for j in range(int(found.windows.max())):
            gone = (found.windows > j) & ~(leads & ((masks[found.entry] >> j) & 1 == 1))
            np.add.at(step, found.start[gone] + j, 1)
            np.add.at(step, found.start[gone] + j + WINDOW, -1)
    removed = np.cumsum(step)[:-1] > 0
    n_removed = np.add.reduceat(np.append(removed, False), words.first[:-1], dtype=np.int64) if len(texts) else np.empty(0, np.int64)
    n_words = np.diff(words.first)
    n_removed[n_words == 0] = 0
    kept = []
    for i, whole in enumerate(texts):
        left = whole.split()
        if n_removed[i]:
            left = compress(left, (~removed[words.first[i] : words.first[i + 1]]).tolist())
        kept.append(b" ".join(left).decode())
    made = {"n_words": n_words, "n_removed": n_removed, "kept": kept}
    return pa.Table.from_arrays(
        [pa.array(made[f.name], f.type) if f.name in made else docs.column(f.name).cast(f.type) for f in schema], schema=schema
    )


def without_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with n_words, n_removed and kept, the words that are left joined by one space."""
    rows, names = renamed(df)
    doc_id, text = names[doc_id], names[text]
    if not isinstance(rows.schema[doc_id].dataType, T.IntegralType):
        # ids of another type are compared by their place among all ids
        ids = rows.select(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id")).distinct()
        ids = stored(ids, "ids")
        placed = ranked(ids, ["none", "id"], ids.count(), "place").drop("none")
        rows = rows.join(placed, F.col(doc_id).eqNullSafe(F.col("id"))).drop("id")
        doc_id = "place"
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches = max(1, -(-size // BATCH_BYTES))
    shards = max(1, -(-size // (6 * SHARD_KEYS)))
    batch = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(batches))
    docs = rows.withColumn("batch", batch).repartition(int(batches), "batch")
    grouped = docs.groupBy("batch")
    all_columns = T.StructType([*rows.schema, *ADDED])
    schema = to_arrow_schema(all_columns)

    counts = grouped.applyInArrow(
        lambda key, rows: _minimizers(rows, key[0].as_py(), text), "batch long, key long, n long"
    )
    answer = "batch long, kind long, key long, value long"
    repeated = counts.groupBy(F.pmod("key", F.lit(shards)).alias("shard")).applyInArrow(_repeated, answer)

    def sent(key, rows: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, _, found, _ = _candidates(rows, answers, doc_id, text)
        lead = np.array(found.leads, np.int64)
        return pa.table(
            {
                "batch": np.full(len(lead), key[0].as_py(), np.int64),
                "entry": np.arange(len(lead)),
                "route": found.route,
                "body": pa.array(found.bodies, pa.binary()),
                "id": found.id[lead] if len(lead) else np.empty(0, np.int64),
                "at": found.at[lead] if len(lead) else np.empty(0, np.int64),
            }
        )

    candidates = grouped.cogroup(repeated.groupBy("batch")).applyInArrow(
        sent, "batch long, entry long, route long, body binary, id long, at long"
    )
    index_shards = max(1, -(-size // (6 * SHARD_WORDS)))
    masks = candidates.groupBy(F.pmod("route", F.lit(index_shards)).alias("shard")).applyInArrow(_first_starts, answer)
    out = grouped.cogroup(repeated.unionByName(masks).groupBy("batch")).applyInArrow(
        lambda rows, answers: _without(rows, answers, doc_id, text, schema), all_columns
    )
    return named_back(out, names, ADDED.names)
