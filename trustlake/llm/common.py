"""What the operators of this subpackage share: batches in, columns added, written intermediates, words.

A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and carriage
return, unchanged. In UTF-8 these six are single bytes, so ``bytes.split()`` gives exactly the words.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trustlake.session import checkpoint_dir

#: The same words as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a batch that are worked on at a time; what a task holds besides follows from it.
PART_BYTES = 4 << 20

Columns = Callable[[Iterator[pa.RecordBatch]], Iterable[tuple[pa.RecordBatch, list[pa.Array]]]]


def n_words(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_or_empty(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def bytes_or_empty(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of the texts, taken from Arrow's buffer without decoding; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if t is None else t for t in column.cast(kind).to_pylist()]


def parts(batches: Iterable[pa.RecordBatch], size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``size`` bytes, without copying; one long row is a run of its own."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * min(1.0, size / max(batch.nbytes, 1))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def adding(df: DataFrame, added: T.StructType, columns: Columns) -> DataFrame:
    """``df`` with the fields ``added``, which ``columns`` makes from its Arrow batches, one pass and no shuffle."""
    names = [f.name for f in added]
    keep = [f for f in df.schema if f.name not in names]
    schema = T.StructType([*keep, *added])
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, made in columns(parts(batches)):
            old = [(f, batch.column(i)) for i, f in enumerate(batch.schema) if f.name not in names]
            fields = [f for f, _ in old] + list(arrow)
            yield pa.RecordBatch.from_arrays([a for _, a in old] + made, schema=pa.schema(fields))

    return df.mapInArrow(run, schema)


def shared_path(spark, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that later reads do not recompute it."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, both shuffled, whatever their sizes.

    For tables that the planner takes for smaller than they are, such as those with a row for each element of an array:
    it estimates one element, and the driver would collect and broadcast them all.
    """
    return left.join(right.hint("merge"), on, how)


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns _c0, _c1, ..; and the new name of each old one.

    Operators work on the renamed columns, so that a caller's column may have any name, those of the operator's own
    columns included.
    """
    names = {name: f"_c{i}" for i, name in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def named_back(out: DataFrame, names: dict[str, str], made: Iterable[str]) -> DataFrame:
    """The columns of ``renamed`` under their old names, then the columns ``made``, which replace old ones of their names."""
    made = list(made)
    return out.select(*[F.col(new).alias(old) for old, new in names.items() if old not in made], *made)


#: A key that more rows ask for than this, and more than one of HOT_KEYS rows does, is answered by broadcast.
HOT_ROWS, HOT_KEYS = 100_000, 1_000_000


def answered(asked: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``asked`` joined with ``table``, which has one row for each of its keys and, as ``asks``, how many rows ask for it.

    A key's rows go to one task of a join. Keys asked for by more than ``HOT_ROWS`` rows and by more than one in
    ``HOT_KEYS`` of all rows are therefore broadcast: these are fewer than ``HOT_KEYS``, whatever the data.
    """
    sums = table.agg(F.sum("asks").alias("all"), F.max("asks").alias("most")).first()
    limit = max(HOT_ROWS, (sums["all"] or 0) // HOT_KEYS)
    if (sums["most"] or 0) <= limit:
        return asked.join(table.drop("asks"), key)
    hot = F.broadcast(table.filter(F.col("asks") > limit).drop("asks"))
    rest = asked.join(hot.select(key), key, "left_anti").join(table.filter(F.col("asks") <= limit).drop("asks"), key)
    return asked.join(hot, key).unionByName(rest)
