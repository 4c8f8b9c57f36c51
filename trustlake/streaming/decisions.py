"""The live gate, its log, the running length history and the model it uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, IllegalArgumentException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.operators import gate, governance
from trustlake.operators.features import z_score
from trustlake.operators.ranking import strict_history
from trustlake.session import durable
from trustlake.sources.tables import logged_columns, snapshots, spill, write_snapshot
from trustlake.streaming.runner import drain_batches, write_batch

Tables = Callable[[SparkSession], DataFrame]


def live_version(registry: DataFrame, running_version: str, tier: str) -> str | None:
    """The calibrator to use now: newest ready one in production that fits the runtime, else none.

    One row per capability tier comes back, so one label reaches the driver.
    """
    usable = registry.filter((F.col("runtime_version") == running_version) & (F.col("capability_tier") == tier))
    found = governance.newest_ready(usable).select("version").head()
    return None if found is None else found[0]


class LiveModel:
    """The model that scores now. A newer version is taken if it can be loaded; otherwise the one in use stays.

    ``load`` maps a version to the column that scores with it and may raise; the
    version that a row is stamped with is always the one that scored it.
    """

    def __init__(self, load: Callable[[str], Column] | None, p: Column | None, version: str = "bootstrap"):
        self.load, self.p, self.version = load, p, version

    def refresh(self, wanted: str | None) -> str | None:
        """Take ``wanted``; the reason if it is refused."""
        if wanted is None or wanted == self.version:
            return None if wanted else "no usable version"
        if self.load is None:
            return "no loader"
        try:
            p = self.load(wanted)
        except Exception as error:  # a broken artefact must not stop the gate
            return f"{type(error).__name__}: {error}"
        if p is None:
            return "not found"
        self.p, self.version = p, wanted
        return None


SWAPS = "batch bigint, wanted string, used string, refused string"


def stream_decide(
    requests: DataFrame, folder: str, trust: Tables, judgements: Tables, priors: Tables, registry: Tables | None = None,
    running_version: str = "", tier: str = "none", model_p: Column | None = None, review_rate: float | None = None,
    load_model: Callable[[str], Column] | None = None, model_b: Column | None = None,
) -> None:
    """Decide every micro-batch of requests with the batch job and log it.

    Trust, judgements and the registry are read anew for each batch, so a
    recomputed budget takes effect with the next one. So does a newly ready
    calibrator: ``load_model`` gives its score column. If it cannot, the previous
    model goes on, rows keep its stamp, and ``swaps`` tells the reason. ``model_p``
    is the score before any version is loaded, stamped ``bootstrap``.
    """
    live = LiveModel(load_model, model_p)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if registry:
            wanted = live_version(registry(spark), running_version, tier)
            refused = live.refresh(wanted)
            swap = spark.createDataFrame([(batch_id, wanted, live.version, refused)], SWAPS)
            write_batch(swap, f"{folder}/swaps", batch_id)
        options = {} if review_rate is None else {"review_rate": review_rate}
        rows, rejected = gate.decide_batch(
            batch, trust(spark), judgements(spark), priors(spark), model_p=live.p, model_b=model_b,
            calibrator_version=live.version, capability_tier=tier, **options,
        )
        log_batch(rows, f"{folder}/decisions", f"{folder}/spill", batch_id)
        write_batch(rejected, f"{folder}/rejected", batch_id)

    drain_batches(requests, handle, folder)


def log_batch(rows: DataFrame, path: str, spill_path: str, batch_id: int) -> None:
    """Write a batch to the log; where the log cannot be written the rows go to the spill, to be replayed.

    The rows are computed before, so an error in the decision itself is raised, not spilled. So is one that no
    later try can mend, as of a schema or a format; for every other the reason is kept beside the spill.
    """
    logged = durable(logged_columns(rows))
    try:
        write_batch(logged, path, batch_id)
    except (AnalysisException, ParseException, IllegalArgumentException):
        raise
    except Exception as error:  # the storage is not there
        spill(logged, f"{spill_path}/batch={batch_id}")
        why = [(batch_id, type(error).__name__, str(error)[:2000])]
        reasons = logged.sparkSession.createDataFrame(why, "batch bigint, error string, message string")
        write_batch(reasons, f"{spill_path}-reasons", batch_id)


def stream_length_z(replies: DataFrame, folder: str) -> None:
    """Length z-scores of a stream (id, action, ts_us, length) against everything seen before.

    Exact sums per action are carried from batch to batch as a small snapshot
    table; inside a batch the earlier rows are added by the batch operator. A row
    that is not newer than all rows of its action in earlier batches cannot be
    scored against its past alone: it goes to ``late`` and counts in later sums. A
    batch that runs again starts from the same earlier snapshot.
    """
    state = f"{folder}/totals"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [s for s in snapshots(spark, state) if s < batch_id]
        before = spark.read.parquet(f"{state}/snapshot={earlier[-1]}") if earlier else None
        whole = batch
        if before is not None:
            # one row an action
            newest = batch.join(before.select("action", "last_us"), "action", "left")
            behind = F.coalesce(F.col("ts_us") <= F.col("last_us"), F.lit(False))
            write_batch(newest.filter(behind).select(*batch.columns), f"{folder}/late", batch_id)
            batch = newest.filter(~behind).select(*whole.columns)
        value = F.col("length").cast("decimal(10,0)")
        sums = {"n": F.lit(1).cast("bigint"), "s": value.cast("decimal(18,0)"), "q": (value * value).cast("decimal(20,0)")}
        rows = strict_history(batch, ["action"], "ts_us", "id", {f"_{k}": v for k, v in sums.items()})
        totals = whole.groupBy("action").agg(
            F.max("ts_us").alias("last_us"), F.sum(sums["n"]).alias("n"), F.sum(sums["s"]).cast("decimal(28,0)").alias("s"),
            F.sum(sums["q"]).cast("decimal(30,0)").alias("q"),
        )
        if before is not None:
            rows = rows.join(before.drop("last_us"), "action", "left")
            totals = (
                totals.unionByName(before).groupBy("action")
                .agg(F.max("last_us").alias("last_us"), F.sum("n").alias("n"), F.sum("s").cast("decimal(28,0)").alias("s"), F.sum("q").cast("decimal(30,0)").alias("q"))
            )
        else:
            rows = rows.withColumns({k: F.lit(0) for k in ("n", "s", "q")})

        def plus(name: str, kind: str) -> Column:
            return (F.col(f"_{name}") + F.coalesce(F.col(name), F.lit(0))).cast(kind)

        scored = rows.withColumn(
            "length_z", z_score(F.col("length"), plus("n", "bigint"), plus("s", "decimal(18,0)"), plus("q", "decimal(24,0)"))
        )
        write_batch(scored.select(*batch.columns, "length_z"), f"{folder}/out", batch_id)
        write_snapshot(totals, state, batch_id)

    drain_batches(replies, handle, folder)


