"""Alignment of the tokens of two tokenizers, by the byte offsets at which tokens of both end.

Every text is encoded twice: A, a byte-level BPE of the ``tokenizers`` library, encodes a space and the text; B, a
``sentencepiece`` model that puts the space there itself, encodes the text. Both models' files are read on the driver
and broadcast (a few MB, bounded by the vocabularies). From the id lists on, a batch is Arrow and numpy arrays: token
lengths are summed up cumulatively, and flags on the byte offsets tell the cuts, where a token of A and one of B both end.
The tokens between two cuts are a group. Between two neighbouring ends of either tokenizer lies the overlap of exactly one
token of A and one of B: these are the links.

Texts are cut before spaces at which tokens of both end, whatever else the text holds. These units are aligned each by
itself, once as long as a task remembers it; what a document has is its units' tokens, groups and links, one after the
other. A text with a unit whose tokens' bytes are not its own is aligned as a whole.

The count of an id pair is the number of documents that hold it linked. A task counts the pairs of a
batch, Spark adds the batches' counts up, and each batch asks for the counts of its pairs, each once (``common.answered``).
The highest count of each id of A is one row for each id of its vocabulary. Documents travel once, as places in their
batch's list of pairs.

A document has no tokens if it is null or empty, or if the bytes of its tokens, of A or of B, are not a space and the
text (a text with U+2581, which B takes for a space).

Defined cases: very long texts are a batch of their own; rows are independent, repeated rows count as documents of
their own, null ids are ids like others (the id isn't used); ties for the highest count all count as best; an empty table gives no rows. Extra columns are passed through, and
added columns replace columns of their names.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trustlake.llm.bpe import byte_characters
from trustlake.llm.common import answered, parts, renamed, stored, text_or_empty
from trustlake.llm.counting import SAFE, Merges, byte_level, merged_ids, splitter

#: Text bytes and distinct pairs of a batch.
BATCH_BYTES, BATCH_PAIRS = 12 << 20, 1_000_000
#: Text bytes that are encoded at a time: their units and tokens as objects and arrays take some hundred times as much.
PART_BYTES = 1 << 19
#: Links whose counts are summed up at a time.
SUMMED = 1 << 19
#: Pre-tokens whose ids a task remembers; beyond it the memory starts anew.
REMEMBERED = 50_000
#: Units that A cuts at a time; where one can't follow another they are cut each by itself.
TOGETHER = 128
#: Units that a task remembers, and characters in them; beyond it those seen least are forgotten.
UNITS, UNIT_CHARS = 100_000, 4_000_000
#: A character that no version of Unicode takes for white space.
SURE = r"[^\s" + "".join(f"\\U{a + 1:08x}-\\U{b - 1:08x}" for (_, a), (b, _) in zip(SAFE, (*SAFE[1:], (0x110000, 0)))) + "]"

COUNTS = T.StructType([T.StructField(n, T.LongType(), False) for n in ("n_a", "n_b", "n_groups", "n_links")])
#: What ``linked`` keeps for ``counted``: the batch, the links as places in the batch's list of pairs, and in one
#: row of each batch that list with the documents of each pair.
LINKS = T.StructType(
    [
        T.StructField("batch", T.LongType(), False),
        T.StructField("at", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("pairs", T.ArrayType(T.LongType(), False)),
        T.StructField("docs", T.ArrayType(T.IntegerType(), False)),
    ]
)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each row's values; ``first`` is where the rows begin, and the end of the last."""
    return np.diff(np.r_[0, np.cumsum(values, dtype=np.int64)][first])


def _first(sizes) -> np.ndarray:
    """Where rows of these sizes begin, and the end of the last."""
    return np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def _sizes(rows: list) -> np.ndarray:
    return np.fromiter(map(len, rows), np.int64, len(rows))


def _taken(values: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values of the rows ``at``, one after the other."""
    sizes = np.diff(first)[at]
    return values[np.arange(sizes.sum()) + np.repeat(first[at] - (np.cumsum(sizes) - sizes), sizes)]


class _Ids:
    """Ids of pieces of texts, each distinct piece encoded once as long as it is remembered."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.first = np.empty(0, np.int32), np.zeros(1, np.int64)

    def joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one after the other, and how many each has."""
        new = [*set(pieces).difference(self.place)]
        if len(self.place) + len(new) > self.most:
            self._clear()
            new = [*set(pieces)]
        if new:
            ids, sizes = self.encode(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.ids = np.concatenate([self.ids, ids])
            self.first = np.r_[self.first, self.first[-1] + np.cumsum(sizes)]
        at = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        return _taken(self.ids, self.first, at), np.diff(self.first)[at]


class ByteLevel:
    """Tokenizer A: ids of units with a space before them, and the bytes of each id."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.split = splitter(Tokenizer.from_str(spec))
        back = {c: b for b, c in enumerate(byte_characters())}
        # special tokens have no place here: their strings in texts are plain text
        model = byte_level(spec)["model"]
        self.bytes_of = [b""] * (max(model["vocab"].values()) + 1)
        for token, at in model["vocab"].items():
            self.bytes_of[at] = bytes(map(back.__getitem__, token))
        self.merges = Merges(model)
        self.known = _Ids(self._encoded, REMEMBERED)

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = merged_ids([p.encode() for p in new], self.merges)
        return np.frombuffer(b"".join(ids), np.int32), _sizes(ids) // 4

    def _cut(self, spaced: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of the units, and where each unit's begin."""
        runs = [spaced[i : i + TOGETHER] for i in range(0, len(spaced), TOGETHER)]
        rows = [self.split("".join(run)) for run in runs]
        unit_ends = np.cumsum(_sizes(spaced))
        while True:
            pieces = [*chain.from_iterable(rows)]
            ends = np.cumsum(_sizes(pieces))
            last = np.searchsorted(ends, unit_ends)
            over = np.flatnonzero(ends[last] != unit_ends)
            if not len(over):
                return pieces, np.r_[0, last + 1]
            for i in np.unique(over // TOGETHER).tolist():
                rows[i] = [*chain.from_iterable(map(self.split, runs[i]))]

    def ids(self, units: list[str]) -> pa.ListArray:
        pieces, first = self._cut([" " + u for u in units])
        ids, sizes = self.known.joined(pieces)
        return _lists(ids, _first(sizes)[first])


class Pieces:
    """Tokenizer B: ids of units, given without the space that it adds itself, and the bytes of each id.

    If no piece holds a space after another character, no merge reaches over the place before a space, and the runs
    of spaces and what follows them are encoded each once; otherwise whole texts are.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)
        self.space = self.model.piece_to_id("▁")
        # a space less than the run has, since the model adds one
        self.runs = re.compile(" ( *[^ ]*)").findall
        self.known = _Ids(self._encoded, 0)

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(new, num_threads=1)
        if self.apart and "" in new:
            # of an empty text nothing is left that the model would put its space before
            found[new.index("")] = [self.space]
        sizes = _sizes(found)
        return np.fromiter(chain.from_iterable(found), np.int32, sizes.sum()), sizes

    def ids(self, units: list[str]) -> pa.ListArray:
        rows = [self.runs(" " + u) if self.apart and " " in u else (u,) for u in units]
        ids, sizes = self.known.joined([*chain.from_iterable(rows)])
        return _lists(ids, _first(sizes)[_first(_sizes(rows))])


def _lists(ids: np.ndarray, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))


class Side:
    """One tokenizer's tokens of a batch: their ids, and their ends as byte offsets in the batch."""

    def __init__(self, lists: pa.ListArray, lengths: np.ndarray):
        self.ids, self.first = lists.values.to_numpy(), np.asarray(lists.offsets)
        running = np.r_[0, np.cumsum(lengths[self.ids])]
        self.end, self.row_ends = running[1:], running[self.first]
        self.n = np.diff(self.first).astype(np.int64)

    def ends(self) -> np.ndarray:
        """For each offset whether a token ends there."""
        out = np.zeros(self.row_ends[-1] + 1, bool)
        out[self.end] = True
        return out


def _whole(lists: pa.ListArray, tokens: pa.Array, expected: pa.Array) -> pa.Array:
    """Whether the bytes of each row's tokens are the ones expected."""
    pieces = pa.ListArray.from_arrays(lists.offsets, pc.take(tokens, lists.values))
    return pc.equal(pc.binary_join(pieces, pa.scalar(b"", pa.binary())), expected)


def _emptied(lists: pa.ListArray, kept: pa.Array) -> pa.ListArray:
    """The lists, those that aren't kept without what they hold."""
    keep, first = kept.to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
    sizes = np.diff(first)
    return _lists(lists.values.to_numpy()[np.repeat(keep, sizes)], _first(sizes * keep))


class Units:
    """What a task remembers of units: their places here, and by place the counts, groups and links of each.

    ``whole`` tells whether the bytes of a unit's tokens are its own; a unit of which they are not has no tokens.
    """

    def __init__(self):
        self.place: dict[str, int] = {}
        self.chars = 0
        self.counts = np.empty((0, 4), np.int64)
        self.whole, self.seen = np.empty(0, bool), np.empty(0, np.int64)
        self.groups = pa.array([], pa.string())
        self.first, self.pairs = np.zeros(1, np.int64), np.empty(0, np.int64)

    def add(self, units: list[str], counts: list[np.ndarray], whole: np.ndarray, groups: pa.Array, pairs: np.ndarray) -> None:
        self.place.update(zip(units, range(len(self.place), len(self.place) + len(units))))
        self.chars += sum(map(len, units))
        self.counts = np.concatenate([self.counts, np.column_stack(counts)])
        self.whole = np.r_[self.whole, whole]
        self.seen = np.r_[self.seen, np.zeros(len(units), np.int64)]
        self.groups = pa.concat_arrays([self.groups, groups])
        self.first = np.r_[self.first, self.first[-1] + np.cumsum(counts[3])]
        self.pairs = np.r_[self.pairs, pairs]

    def links(self, at: np.ndarray) -> np.ndarray:
        """The id pairs of the links of the units at these places."""
        return _taken(self.pairs, self.first, at)

    def forget(self) -> None:
        """If there are too many, keeps half of them at most: those seen twice, or oftener, of late."""
        if len(self.place) <= UNITS and self.chars <= UNIT_CHARS:
            return
        least = 2
        while np.count_nonzero(self.seen >= least) > UNITS // 2:
            least *= 2
        kept = self.seen >= least
        units = [*compress(self.place, kept.tolist())]
        if self.chars > UNIT_CHARS and sum(map(len, units)) > UNIT_CHARS // 2:
            return self.__init__()
        at = np.flatnonzero(kept)
        old, self.place, self.chars = self.seen[at] // 2, {}, 0
        pairs, groups = self.links(at), self.groups.take(pa.array(at))
        counts, whole = self.counts[at], self.whole[at]
        self.__init__()
        self.add(units, [*counts.T], whole, groups, pairs)
        self.seen = old


class Aligner:
    """In a task: tokens, groups and links of texts."""

    def __init__(self, spec: str, model: bytes):
        self.a, self.b = ByteLevel(spec), Pieces(model)
        self.tokens = [pa.array(side.bytes_of, pa.binary()) for side in (self.a, self.b)]
        self.lengths = [pc.binary_length(t).to_numpy().astype(np.int64) for t in self.tokens]
        # ids as text, each followed by what may follow it: the next one or the end of its side
        self.shown = pa.array([f"{i}{end}" for n, ends in zip(map(len, self.tokens), (",|", ",;")) for i in range(n) for end in ends])
        # A cuts before a space after a character that isn't white space, and before a single one that such a character
        # follows; a space before a unit is left out
        self.unsure = re.compile(f" (?!{SURE})").search
        self.cut = re.compile(f" ( *[^ ]*(?:(?<!{SURE}) (?!{SURE}) *[^ ]*)*)").findall
        self.known = Units()

    def _units(self, text: str) -> list[str]:
        if not text or not self.b.apart:
            return [text] if text else []
        if text[0] != " " and self.unsure(text) is None:
            return text.split(" ")
        return self.cut(" " + text)

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], pa.Array, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links; groups as text; document and id pair of each link) of a batch."""
        known = self.known
        known.forget()
        rows = [self._units(t) for t in texts]
        at, first = self._places(rows)
        odd = np.flatnonzero(_sums(~known.whole[at], first))
        if len(odd):
            for i in odd.tolist():
                rows[i] = [texts[i]]
            at, first = self._places(rows)
        known.seen += np.bincount(at, minlength=len(known.seen))
        counts = [_sums(c[at], first) for c in known.counts.T]
        groups = pa.ListArray.from_arrays(pa.array(first, pa.int32()), known.groups.take(pa.array(at)))
        return counts, pc.binary_join(groups, ";"), np.repeat(np.arange(len(texts)), counts[3]), known.links(at)

    def _places(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The place of each unit of the rows, and where the rows begin; new units are aligned."""
        new = [*set(chain.from_iterable(rows)).difference(self.known.place)]
        if new:
            self.known.add(new, *self._aligned(new))
        first = _first(_sizes(rows))
        return np.fromiter(map(self.known.place.__getitem__, chain.from_iterable(rows)), np.int64, first[-1]), first

    def _aligned(self, units: list[str]) -> tuple[list[np.ndarray], np.ndarray, pa.Array, np.ndarray]:
        """(n_a, n_b, n_groups, n_links; whether it is whole; groups as text) of each unit, and the id pairs of the links."""
        lists = [side.ids(units) for side in (self.a, self.b)]
        expected = pa.array([" " + u for u in units], pa.string()).cast(pa.binary())
        whole = pc.and_(*[_whole(x, tokens, expected) for x, tokens in zip(lists, self.tokens)])
        lists = [x if pc.all(whole).as_py() else _emptied(x, whole) for x in lists]
        a, b = (Side(x, lengths) for x, lengths in zip(lists, self.lengths))

        # whole units have the same bytes on both sides, so a unit begins at the same offset of both
        ends_a, ends_b = a.ends(), b.ends()
        last_a, last_b = ends_b[a.end], ends_a[b.end]
        # an interval between neighbouring ends lies in the first token of either side that ends at it or later
        ends = np.flatnonzero(ends_a | ends_b)
        at_a, at_b = (np.cumsum(x[ends]) - x[ends] for x in (ends_a, ends_b))
        pairs = a.ids[at_a].astype(np.int64) << 32 | b.ids[at_b]
        n_links = np.diff(np.searchsorted(ends, a.row_ends, side="right"))
        counts = [a.n, b.n, _sums(last_a, a.first), n_links]
        return counts, whole.to_numpy(zero_copy_only=False), self._groups(a, b, last_a, last_b), pairs

    def _groups(self, a: Side, b: Side, last_a: np.ndarray, last_b: np.ndarray) -> pa.Array:
        """The groups of each unit as text: ``a1,a2|b1;a3|b2,b3``."""
        group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
        before_a, before_b = (np.r_[0, np.flatnonzero(x) + 1] for x in (last_b, last_a))
        shown = np.empty(len(a.ids) + len(b.ids), np.int64)
        # a group's tokens of A come before its tokens of B
        shown[np.arange(len(a.ids)) + before_a[group_a]] = 2 * a.ids + last_a
        shown[np.arange(len(b.ids)) + before_b[group_b + 1]] = 2 * (len(self.tokens[0]) + b.ids.astype(np.int64)) + last_b
        rows = pa.ListArray.from_arrays(pa.array(a.first + b.first, pa.int32()), pc.take(self.shown, pa.array(shown)))
        return pc.utf8_rtrim(pc.binary_join(rows, ""), ";")


class Batch:
    """The distinct id pairs of a batch, in order of first sight, with the number of documents of each."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.sorted, self.place = np.empty(0, np.int64), np.empty(0, np.int64)
        self.docs = np.empty(0, np.int64)

    def add(self, doc: np.ndarray, pair: np.ndarray, size: int) -> np.ndarray:
        """The places of the links' pairs; the documents are new ones."""
        self.size += size
        coded = pa.array(pair).dictionary_encode()
        pairs, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        each = pc.unique(pa.array(doc * len(pairs) + code)).to_numpy()
        order = np.argsort(pairs)
        at = np.searchsorted(self.sorted, pairs[order])
        new = np.r_[self.sorted, -1][at] != pairs[order]
        total = len(self.sorted)
        self.place = np.insert(self.place, at[new], total + np.arange(np.count_nonzero(new)))
        self.sorted = np.insert(self.sorted, at[new], pairs[order][new])
        self.docs = np.r_[self.docs, np.zeros(len(self.sorted) - total, np.int64)]
        place = self.place[np.searchsorted(self.sorted, pairs)]
        if len(pairs):
            self.docs[place] += np.bincount(each % len(pairs), minlength=len(pairs))
        return place[code].astype(np.int32)

    def pairs(self) -> np.ndarray:
        out = np.empty(len(self.sorted), np.int64)
        out[self.place] = self.sorted
        return out


def linked(
    df: DataFrame, path_a: str, path_b: str, text: str = "text", groups: str = "groups", links: str = "links"
) -> DataFrame:
    """``df`` with n_a, n_b, n_groups, n_links, ``groups`` and ``links`` of its whole texts.

    ``path_a`` is the .json file of A, ``path_b`` the .model file of B. ``groups`` is text, ``a1,a2|b1;a3|b2,b3`` of the
    ids. ``links`` is what ``counted`` reads; the rows must be written as they are before.
    """
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        files = a.read(), b.read()
    byte_level(files[0])
    shared = df.sparkSession.sparkContext.broadcast(files)
    added = T.StructType([*COUNTS, T.StructField(groups, T.StringType(), False), T.StructField(links, LINKS, False)])
    names = [f.name for f in added]
    schema = T.StructType([*[f for f in df.schema if f.name not in names], *added])
    arrow = to_arrow_schema(added)
    link_type = arrow.field(links).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(*shared.value)
        numbers = iter(range(TaskContext.get().partitionId() << 32, 1 << 62))
        batch, waiting = Batch(next(numbers)), None
        for part in parts(batches, PART_BYTES):
            if batch.size >= BATCH_BYTES or len(batch.sorted) >= BATCH_PAIRS:
                yield _closed(waiting, batch)
                batch, waiting = Batch(next(numbers)), None
            if waiting is not None:
                yield _open(*waiting, batch.number, None)
            texts = text_or_empty(part.column(text))
            counts, shown, doc, pair = align(texts)
            waiting = part, counts, shown, batch.add(doc, pair, sum(map(len, texts)))
        if waiting is not None:
            yield _closed(waiting, batch)
        # the worker lives on in later stages
        del align, batch, waiting
        pa.default_memory_pool().release_unused()

    def _closed(waiting: tuple, batch: Batch) -> pa.RecordBatch:
        """The last rows of a batch; the first of them has the batch's pairs."""
        return _open(*waiting, batch.number, (batch.pairs(), batch.docs.astype(np.int32)))

    def _open(part: pa.RecordBatch, counts: list, shown: pa.Array, at: np.ndarray, number: int, asked: tuple | None) -> pa.RecordBatch:
        n = part.num_rows
        ends = pa.array(np.r_[0, np.cumsum(counts[3])], pa.int32())
        places = pa.ListArray.from_arrays(ends, pa.array(at), type=link_type.field("at").type)
        of_batch = [
            pa.array([None if asked is None or i else asked[j] for i in range(n)], link_type.field(2 + j).type) for j in range(2)
        ]
        fields = [link_type.field(i) for i in range(link_type.num_fields)]
        struct = pa.StructArray.from_arrays([pa.array(np.full(n, number, np.int64)), places, *of_batch], fields=fields)
        old = [(f, part.column(i)) for i, f in enumerate(part.schema) if f.name not in names]
        made = [*[pa.array(c.astype(np.int64)) for c in counts], shown, struct]
        return pa.RecordBatch.from_arrays([c for _, c in old] + made, schema=pa.schema([f for f, _ in old] + list(arrow)))

    return df.mapInArrow(run, schema)


def pair_counts(asked: DataFrame) -> DataFrame:
    """(pair, n, asks, best): documents that hold each pair linked, rows that ask for it, and whether no pair of its id of A has more.

    ``asked`` has (batch, at, pair, docs).
    """
    counts = asked.groupBy("pair").agg(F.sum("docs").alias("n"), F.count(F.lit(1)).alias("asks"))
    # one row for each id of A at most
    highest = counts.groupBy(F.shiftright("pair", 32).alias("_a")).agg(F.max("n").alias("_most"))
    joined = counts.join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("_a"))
    return joined.select("pair", "n", "asks", (F.col("n") == F.col("_most")).alias("best"))


def counted(rows: DataFrame, links: str = "links") -> DataFrame:
    """``rows`` with n_best and count_sum instead of ``links``; ``rows`` was made by ``linked``, written and read again."""
    made = ("n_best", "count_sum")
    kept = T.StructType([f for f in rows.schema if f.name not in (*made, links)])
    rows, names = renamed(rows)
    of = F.col(names[links])
    listed = rows.filter(of["pairs"].isNotNull()).select(of["batch"].alias("batch"), F.arrays_zip(of["pairs"], of["docs"]).alias("all"))
    asked = listed.select("batch", F.posexplode("all").alias("at", "each")).select(
        "batch", "at", F.col("each.pairs").alias("pair"), F.col("each.docs").cast("long").alias("docs")
    )
    counts = stored(pair_counts(asked), "pair-counts")
    answers = answered(asked.drop("docs"), counts, "pair").select("batch", "at", "n", "best")

    schema = T.StructType([*kept, *[T.StructField(n, T.LongType(), False) for n in made]])
    arrow = to_arrow_schema(schema)

    def summed(docs: pa.Table, found: pa.Table) -> pa.Table:
        size = found.num_rows
        at = found.column("at").to_numpy()
        n, best = np.zeros(size, np.int64), np.zeros(size, bool)
        n[at], best[at] = found.column("n").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        first = _first(docs.column(names["n_links"]).to_numpy())
        sums = np.zeros((2, docs.num_rows), np.int64)
        runs = np.unique(first[:-1] // SUMMED, return_index=True)[1].tolist()
        for i, j in zip(runs, [*runs[1:], docs.num_rows]):
            places = pc.list_flatten(docs.column("at").slice(i, j - i)).to_numpy()
            sums[:, i:j] = [_sums(x[places], first[i : j + 1] - first[i]) for x in (best, n)]
        old = [docs.column(names[f.name]).cast(arrow.field(f.name).type) for f in kept]
        return pa.Table.from_arrays([*old, *map(pa.array, sums)], schema=arrow)

    # the list of pairs has done its work and stays behind
    travelling = rows.withColumns({"batch": of["batch"], "at": of["at"]}).drop(names[links])
    return travelling.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(summed, schema)
