"""Reading and writing the table families: corpus files, record, operational tables, snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake import schemas
from trustlake.config import ACTIONS, POLICIES, action_table, policy_table
from trustlake.functions.time import utc_date
from trustlake.operators.features import inject_judge

BROKEN = "_corrupt_record"


def _read_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    schema = schemas.struct(ddl).add(BROKEN, "string")
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", BROKEN).json(path)


def read_turns(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, unusable lines) of a corpus in JSON lines; blank lines are skipped.

    Unusable are lines that do not parse and lines without a turn id; nothing is dropped.

    The corpus is not sorted here: what depends on time orders by ``ts_us`` itself.
    """
    rows = _read_lines(spark, path, schemas.TURN)
    good = F.col(BROKEN).isNull() & F.col("turn_id").isNotNull()
    turns = rows.filter(good).drop(BROKEN).withColumn("ts_us", F.round(F.col("ts") * 1_000_000).cast("bigint"))
    line = F.coalesce(F.col(BROKEN), F.to_json(F.struct(*[c for c in rows.columns if c != BROKEN])))
    return turns, rows.filter(~good).select(line.alias("line"))


def read_judgements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(one judgement per turn, the last line wins; broken lines as ``line``).

    Lines are ordered by file name, position of the block in the file, and line
    within the block, so "last" is well defined for a directory of files.
    """
    lines = _read_lines(spark, path, schemas.JUDGEMENT)
    good = F.col(BROKEN).isNull() & F.col("turn_id").isNotNull()
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    line = F.coalesce(F.col(BROKEN), F.to_json(F.struct(*[c for c in lines.columns if c != BROKEN])))
    return last_judgement(lines.filter(good).withColumn("seq", place), F.col("seq")), lines.filter(~good).select(line.alias("line"))


def last_judgement(rows: DataFrame, seq: Column) -> DataFrame:
    """Latest row per turn by ``seq``; a grouping, so repeated lines fold on the map side."""
    fields = ["model", "thinking", "p_wrong", "verdict", "reasons"]
    present = [f for f in fields if f in rows.columns]
    newest = F.max_by(F.struct(*present), seq)
    return rows.groupBy("turn_id").agg(newest.alias("_j")).select("turn_id", "_j.*")


def read_record(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The four tables of the system of record, with their declared types."""
    return {
        name: spark.read.schema(schemas.struct(ddl)).parquet(f"{directory}/{name}")
        for name, ddl in schemas.RECORD.items()
    }


def ensure_tables(spark: SparkSession, database: str = "default", location: str | None = None) -> list[str]:
    """Create the six operational tables where they are missing; a new database is put at ``location``."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{location}'" if location else ""))
    for name, ddl in schemas.OPERATIONAL.items():
        partitioned = " PARTITIONED BY (dt, action)" if name == "decision" else ""
        columns = f"{ddl}, dt date" if name == "decision" else ddl
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{partitioned}")
    return [f"{database}.{name}" for name in schemas.OPERATIONAL]


def logged_columns(decisions: DataFrame) -> DataFrame:
    """Exactly the columns the live path writes, features as JSON text."""
    out = decisions
    if "features" not in out.columns:
        out = out.withColumn("features", F.lit("{}"))
    elif out.schema["features"].dataType.typeName() == "struct":
        out = out.withColumn("features", F.to_json("features"))
    return out.select(*schemas.LOGGED)


def append_decisions(decisions: DataFrame, path: str) -> None:
    """Append to the decision log, partitioned by day and action.

    Rows are brought together by (day, action) before the write, and adaptive
    execution splits what is too large for a file, so a hot action makes as many
    files as its size asks for.
    """
    rows = logged_columns(decisions).withColumn("dt", utc_date(F.col("ts_us")))
    rows.hint("rebalance", F.col("dt"), F.col("action")).write.mode("append").partitionBy("dt", "action").parquet(path)


def write_snapshot(table: DataFrame, root: str, snapshot: int) -> str:
    """Write one version of a mutable table to its own directory; readers take the newest complete one."""
    path = f"{root}/snapshot={snapshot}"
    table.write.mode("overwrite").parquet(path)
    return path


def file_system(spark: SparkSession, path: str):
    """(file system, path, JVM) of a Hadoop path."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path, jvm


def snapshots(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete snapshots under ``root``."""
    fs, base, jvm = file_system(spark, root)
    if not fs.exists(base):
        return []
    done = []
    for status in fs.listStatus(base):
        name = status.getPath().getName()
        if name.startswith("snapshot=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            done.append(int(name.split("=")[1]))
    return sorted(done)


def read_snapshot(spark: SparkSession, root: str, ddl: str | None = None) -> DataFrame | None:
    found = snapshots(spark, root)
    if not found:
        return None
    reader = spark.read if ddl is None else spark.read.schema(schemas.struct(ddl))
    return reader.parquet(f"{root}/snapshot={found[-1]}")


#: Segments of one length that are merged into the next length.
FAN = 8


def append_segment(rows: DataFrame, root: str, run: int) -> None:
    """What run number ``run`` (from 1) adds to an append-only log; a run that is done again replaces its own rows."""
    rows.write.mode("overwrite").parquet(f"{root}/from={run}-to={run}")


def segments(spark: SparkSession, root: str, upto: int) -> list[str]:
    """The complete segments that together hold the runs 1 to ``upto``, each as long as there is."""
    fs, base, jvm = file_system(spark, root)
    ends: dict[int, list[int]] = {}
    for status in fs.listStatus(base) if fs.exists(base) else []:
        name = re.fullmatch(r"from=(\d+)-to=(\d+)", status.getPath().getName())
        if name and int(name[2]) <= upto and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            ends.setdefault(int(name[1]), []).append(int(name[2]))
    found, at = [], 1
    while at <= upto:
        if at not in ends:
            raise FileNotFoundError(f"run {at} is missing under {root}")
        found.append(f"{root}/from={at}-to={max(ends[at])}")
        at = max(ends[at]) + 1
    return found


def read_segments(spark: SparkSession, root: str, upto: int) -> DataFrame | None:
    """The log of the runs 1 to ``upto``."""
    paths = segments(spark, root, upto)
    return spark.read.parquet(*paths) if paths else None


def compact_segments(spark: SparkSession, root: str, run: int, fan: int = FAN) -> None:
    """After every ``fan`` runs their segments become one, after ``fan`` of those these become one, and so on.

    A row is so written once for each power of ``fan`` up to the number of runs. Merged segments stay until ``vacuum_segments``.
    """
    length = fan
    while run % length == 0:
        first = run - length + 1
        pieces = [f"{root}/from={a}-to={a + length // fan - 1}" for a in range(first, run + 1, length // fan)]
        spark.read.parquet(*pieces).write.mode("overwrite").parquet(f"{root}/from={first}-to={run}")
        length *= fan


def vacuum_segments(spark: SparkSession, root: str, upto: int) -> int:
    """Delete the segments that longer ones hold; how many there were. No reader of them may be running."""
    fs, base, _ = file_system(spark, root)
    kept = {path.rpartition("/")[2] for path in segments(spark, root, upto)}
    gone = 0
    for status in fs.listStatus(base):
        name = re.fullmatch(r"from=\d+-to=(\d+)", status.getPath().getName())
        if name and int(name[1]) <= upto and name[0] not in kept:
            gone += bool(fs.delete(status.getPath(), True))
    return gone


def spill(rows: DataFrame, path: str) -> None:
    """Put overflow rows aside as JSON lines with the log's own columns."""
    logged_columns(rows).write.mode("append").json(path)


def replay_spill(log: DataFrame, spilled: DataFrame) -> DataFrame:
    """Log plus spilled rows, each id once; the log's row wins."""
    late = spilled.dropDuplicates(["id"]).join(log.select("id"), "id", "left_anti")
    return log.unionByName(late.select(*log.columns))


def read_spill(spark: SparkSession, path: str) -> DataFrame:
    fields = [f for f in schemas.struct(schemas.DECISION).fields if f.name in schemas.LOGGED]
    from pyspark.sql.types import StructType

    return spark.read.schema(StructType(fields)).json(path)


def write_feature_cache(features: DataFrame, path: str) -> None:
    """Keep assembled features per turn; only the judge's feature changes between runs."""
    features.select("turn_id", "features").write.mode("overwrite").parquet(path)


def uncached(turns: DataFrame, cached: DataFrame) -> DataFrame:
    """Ids of turns that the cache lacks.

    The cache compresses so well that its ids look small enough to be broadcast; they are as many as the turns, so
    they are merged.
    """
    return turns.select("turn_id").join(cached.select("turn_id").hint("merge"), "turn_id", "left_anti")


def read_feature_cache(spark: SparkSession, path: str, turns: DataFrame, judgements: DataFrame) -> DataFrame | None:
    """Cached features with the judge's answer put in, or None when a turn is missing from the cache."""
    fs, base, _ = file_system(spark, path)
    if not fs.exists(base):
        return None
    cached = spark.read.parquet(path)
    if not uncached(turns, cached).isEmpty():
        return None
    return inject_judge(cached, judgements)


def dims(spark: SparkSession, actions=ACTIONS, policies=POLICIES) -> tuple[DataFrame, DataFrame]:
    """The two configuration tables, for broadcasting; both have one row per configured entry."""
    return action_table(spark, actions), policy_table(spark, policies)


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document from an already aggregated table."""
    report.coalesce(1).write.mode("overwrite").json(path)
