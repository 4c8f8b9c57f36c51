"""Exact top-k search by inner product with Fagin's threshold algorithm.

The rows are dealt into shards of bounded size, the queries into blocks. Each (block, shard) is one piece of
work: it holds the shard's vectors in one sorted list for each dimension and reads all lists in step, from the
large end where the query's component is positive and from the small end where it is negative. Every row met is
scored in full. The sum of query component times list value at the depth reached bounds all rows not met yet; the
search of a query stops when this bound is below its k-th score, so also no tie can be missed. The best k of each
shard meet in one last ranking by query.

Components are turned into integers, floor(scale * x), before anything else, so scores are exact. Defined cases:
vectors that are null or hold a null or non-finite component, and rows without an id, take no part; components
that are missing at the end of a shorter vector are zero; a repeated row is a candidate of its own, except for
queries with the same id, whose own it is; a repeated query row is answered once for each row; a query with fewer
than k candidates gets all of them; an empty table or no query gives no rows. Sums beyond 64 bits are cut to the
largest or smallest long. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard and queries of a block; a shard of 64 components is held in about 8 MB.
SHARD_ROWS, BLOCK_QUERIES = 8192, 2048
#: Entries read from every list at first; the number doubles, so a long search takes few steps.
DEPTH = 32


def integers(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as longs, null where the vector takes no part."""
    x = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    rows = np.repeat(np.arange(len(lists)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


class SortedLists:
    """The rows of a shard in ascending order of each component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        # row numbers and values by dimension; position in the list runs along the second axis
        self.order = np.ascontiguousarray(np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.ascontiguousarray(np.sort(self.rows, axis=0).T)
        largest = int(np.abs(self.rows.astype(object)).max()) if rows.size else 0
        self.largest, self.floats = largest, self.rows.astype(np.float64)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k rows other than the query's own: highest score, then smallest id."""
        n = len(self.rows)
        score = self._scorer(query)
        dims = np.flatnonzero(query)
        up = query[dims] < 0
        seen = self.ids == query_id  # not candidates
        kept, scores = np.empty(0, np.int64), score(np.empty(0, np.int64))
        done, step = 0, DEPTH
        if not len(dims):  # every score is zero
            kept = np.flatnonzero(~seen)[:k]
            return self.ids[kept], score(kept)
        while done < n:
            upto = min(n, done + step)
            near = np.where(up[:, None], self.order[dims, done:upto], self.order[dims, n - upto : n - done])
            met = np.zeros(n, bool)
            met[near] = True
            met &= ~seen
            fresh = np.flatnonzero(met)
            seen[fresh] = True
            kept, scores = np.concatenate((kept, fresh)), np.concatenate((scores, score(fresh)))
            best = np.lexsort((kept, ~scores))[:k]  # row numbers follow the ids; ~ turns the order without overflow
            kept, scores = kept[best], scores[best]
            done, step = upto, step * 2
            if done < n and len(kept) == k:
                edge = np.where(up, self.values[dims, done], self.values[dims, n - 1 - done])
                if sum(int(a) * int(b) for a, b in zip(query[dims], edge)) < int(scores[-1]):
                    break
        return self.ids[kept], scores

    def _scorer(self, query: np.ndarray):
        """Exact inner products: in doubles while all sums fit into 53 bits, else in whole numbers."""
        bound = self.largest * int(np.abs(query.astype(object)).sum())
        if bound < 1 << 53:
            floats = query.astype(np.float64)
            return lambda at: (self.floats[at] @ floats).astype(np.int64)
        if bound < 1 << 63:
            return lambda at: self.rows[at] @ query
        low, high = -(1 << 63), (1 << 63) - 1
        whole = query.astype(object)
        return lambda at: np.array([min(max(int(r @ whole), low), high) for r in self.rows[at].astype(object)], np.int64)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "vector"
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the best ``k`` rows of ``vectors`` for each row of ``queries``.

    Both frames have an integer id and a vector of longs as ``integers`` makes it; null ids or vectors take no
    part. Rows and queries are numbered where they are read, so shards and blocks are even whatever the ids are.
    """
    usable = F.col(vec_id).isNotNull() & F.col(vector).isNotNull()
    rows = vectors.filter(usable).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = queries.filter(usable).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    n_rows, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_asked, wide = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(1, width or 0, wide or 0)
    shards, blocks = max(1, -(-n_rows // SHARD_ROWS)), max(1, -(-n_asked // BLOCK_QUERIES))
    number = F.monotonically_increasing_id()
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(number), F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    numbered = asked.withColumn("at", number)
    spread = numbered.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    )

    def piece(block: pa.Table, shard: pa.Table) -> pa.Table:
        out: dict[str, list] = {"at": [], "query_id": [], "vec_id": [], "score": []}
        if block.num_rows and shard.num_rows:
            lists = SortedLists(shard.column("id").to_numpy(), _matrix(shard.column("v"), width))
            found = zip(block.column("at").to_pylist(), block.column("id").to_pylist(), _matrix(block.column("v"), width))
            for at, query_id, query in found:
                ids, scores = lists.search(query_id, query, k)
                out["at"] += [at] * len(ids)
                out["query_id"] += [query_id] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})

    best = spread.groupBy("block", "shard").cogroup(dealt.groupBy("block", "shard")).applyInArrow(
        piece, "at long, query_id long, vec_id long, score long"
    )
    # k rows a shard meet here
    ranking = Window.partitionBy("query_id", "at").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
