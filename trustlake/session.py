"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "trustlake", master: str | None = None, cores: int = 8, **conf) -> SparkSession:
    """A session with the settings this library relies on (UTC, AQE with skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", "16g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local run without one gets a scratch folder."""
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    current = sc.getCheckpointDir()
    if current is None:
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="trustlake-checkpoint-")
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    return current


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Row placement is frozen, so a lost executor re-reads files instead of
    recomputing (and maybe re-partitioning) the lineage.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder in columns, for tables of which later passes read a few columns each."""
    path = f"{checkpoint_dir(df.sparkSession)}/written/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slice_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
