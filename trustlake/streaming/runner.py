"""Running a stream over everything that is there, with its state and output in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from trustlake.session import checkpoint_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the time a query starts."""
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Run an append-mode stream over all available input into a table and read that table."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark, name)
    with settings(spark, **{PROVIDER: ROCKSDB}):
        running = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """Run ``handle`` on every micro-batch of the available input."""
    with settings(stream.sparkSession, **{PROVIDER: ROCKSDB}):
        running = (
            stream.writeStream.foreachBatch(handle)
            .outputMode(mode)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        running.awaitTermination()


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """One directory per micro-batch: a batch that is run again replaces its own output."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
