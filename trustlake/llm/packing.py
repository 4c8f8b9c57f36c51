"""Token ids packed into rows of one length, by best-fit decreasing.

Documents longer than a row are split: whole rows first, the rest like any other piece. The pieces of a chunk are
placed from the longest to the shortest, each into the open row with the least room that is enough. The row is found
in a segment tree over the possible rooms, in as many steps as a row length has bits; a new row is opened if none
fits. A chunk is a bounded number of tokens of one partition, so memory is bounded, nothing is shuffled, and at
most the last few rows of a chunk are loosely filled.

A packed row has the ids as one line of an id matrix (little-endian numbers, padded to the row length), the
cumulative segment lengths as attention kernels read them (0 first), the places where positions start again at 0,
and for each segment its document and its offset there. ``unpacked`` gives the documents' ids back.

Defined cases: null or empty ids make no segment; a repeated row is packed again; a null document id is carried as
null; equal lengths keep their order; an id that does not fit into the number type raises ``OverflowError``. Other
columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Tokens of a chunk, unless one document has more.
CHUNK_TOKENS = 4 << 20
SCHEMA = T.StructType(
    [
        T.StructField("chunk", T.LongType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("resets", T.ArrayType(T.IntegerType())),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("offsets", T.ArrayType(T.IntegerType())),
    ]
)


class Rooms:
    """Open rows by the room that they have left; a segment tree over the rooms tells which are there."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.counts = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.counts[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(row, room) of a row with the smallest room that is at least ``least``; it is no longer open."""
        at = least + self.size
        if not self.counts[at]:
            # up to the first subtree on the right that has a row, then down its left side
            while at > 1 and (at & 1 or not self.counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at <<= 1
                at += not self.counts[at]
        room = at - self.size
        while at:
            self.counts[at] -= 1
            at >>= 1
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: list[int], most: int) -> list[list[int]]:
    """Rows as lists of pieces (their positions in ``lengths``); every length is from 1 to ``most``."""
    rooms, rows = Rooms(most), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[piece])
        row, room = found if found else (len(rows), most)
        if not found:
            rows.append([])
        rows[row].append(piece)
        if room > lengths[piece]:
            rooms.put(room - lengths[piece], row)
    return rows


def _packed(docs: list, ids: list[np.ndarray], length: int, pad: int, kind: str, chunk: int) -> pa.RecordBatch:
    pieces = [(d, at) for d, x in enumerate(ids) for at in range(0, len(x), length)]
    sizes = [min(length, len(ids[d]) - at) for d, at in pieces]
    out: dict[str, list] = {f.name: [] for f in SCHEMA}
    limit = np.iinfo(kind).max
    for number, row in enumerate(best_fit_decreasing(sizes, length)):
        line = np.full(length, pad, kind)
        ends, at = [0], 0
        for p in row:
            d, start = pieces[p]
            part = ids[d][start : start + sizes[p]]
            if part.min() < 0 or part.max() > limit:
                raise OverflowError(f"an id does not fit into {kind}")
            line[at : at + len(part)] = part
            at += len(part)
            ends.append(at)
        values = (chunk, number, at, line.tobytes(), ends, ends[:-1], [docs[pieces[p][0]] for p in row], [pieces[p][1] for p in row])
        for name, value in zip(out, values):
            out[name].append(value)
    schema = to_arrow_schema(SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def packed(
    df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", length: int = 2048, pad: int = 0, kind: str = "<u4"
) -> DataFrame:
    """Packed rows of ``length`` ids each; ``kind`` is the number type in the matrix, ``pad`` fills it up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        docs: list = []
        rows: list[np.ndarray] = []
        held = 0
        for batch in batches:
            lists = batch.column(1)
            for doc, row in zip(batch.column(0).to_pylist(), lists):
                if row.is_valid and len(row):
                    docs.append(doc)
                    rows.append(row.values.to_numpy(zero_copy_only=False))
                    held += len(rows[-1])
                if held >= CHUNK_TOKENS:
                    yield _packed(docs, rows, length, pad, kind, chunk)
                    docs, rows, held, chunk = [], [], 0, chunk + 1
        if docs:
            yield _packed(docs, rows, length, pad, kind, chunk)

    return df.select(F.col(doc_id).cast("long"), F.col(ids).cast("array<int>")).mapInArrow(run, SCHEMA)


def positions(cu_seqlens: str | Column = "cu_seqlens") -> Column:
    """The position of every token in its segment, padding left out."""
    ends = F.col(cu_seqlens) if isinstance(cu_seqlens, str) else cu_seqlens
    lengths = F.zip_with(F.slice(ends, F.lit(2), F.size(ends) - 1), F.slice(ends, F.lit(1), F.size(ends) - 1), lambda b, a: b - a)
    return F.flatten(F.transform(lengths, lambda n: F.sequence(F.lit(0), n - 1)))


def unpacked(rows: DataFrame, kind: str = "<u4") -> DataFrame:
    """(doc_id, offset, ids) of every segment; a document's segments in order of their offsets are its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, offsets, parts = [], [], []
            for line, ends, of, at in zip(*(batch.column(c).to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "offsets"))):
                numbers = np.frombuffer(line, kind)
                docs += of
                offsets += at
                parts += [numbers[a:b].astype(np.int32) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(offsets, pa.int32()), pa.array(parts, pa.list_(pa.int32()))],
                names=["doc_id", "offset", "ids"],
            )

    return rows.select("ids", "cu_seqlens", "doc_ids", "offsets").mapInArrow(run, "doc_id long, offset int, ids array<int>")


def write(rows: DataFrame, path: str) -> None:
    """The packed rows as Parquet: one binary line of the id matrix a row, with its lengths and resets beside it."""
    rows.write.parquet(path)
