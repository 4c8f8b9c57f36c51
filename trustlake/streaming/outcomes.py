"""Outcome reports, closing decisions at their horizon, rolling trust and drift, as streams."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trustlake.config import DAY_US, OUTCOMES, SETTINGS
from trustlake.functions import ledger
from trustlake.operators import drift, outcomes
from trustlake.operators.gate import TRUST_KEYS
from trustlake.operators.trust import earning, trust_rows, upsert_trust
from trustlake.sources.tables import snapshots, write_snapshot
from trustlake.streaming.runner import drain_batches, write_batch

COLUMNS = ["decision_id", "kind", "outcome", "outcome_source", "outcome_us", "events"]


def stream_outcome_ingest(reports: DataFrame, folder: str) -> None:
    """Accept registered reports with their weight; keep the others with a reason. Decisions are never touched."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        accepted, rejected = outcomes.accept_reports(batch)
        write_batch(accepted, f"{folder}/accepted", batch_id)
        write_batch(rejected, f"{folder}/rejected", batch_id)

    drain_batches(reports, handle, folder)


#: A call into the state costs more than the work for a decision, so decisions share state by hash: ``PARTS`` groups of
#: decisions, whose marks lie in ``CELLS`` lists each.
PARTS, CELLS = 4096, 256


class OutcomeCloser(StatefulProcessor):
    """Per decision: remember the heaviest event until the horizon, emit it once, then only count late ones.

    The state of a decision is one event and a counter, never the list of events. A closed decision
    keeps a mark of its id for good, so no later event can close it again. The open decisions of a part are one value,
    read and written once a batch, with one timer at their earliest horizon; of the marks only the cells are read that a batch asks for.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # [id, cell, weight, reported_us, event_id, outcome, source, number of events, fires_ms] of each decision
        self.open = handle.getValueState("open", "rows string")
        self.marks = handle.getMapState("closed", "cell int", "ids string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = self.held()
        timer = min((r[8] for r in held.values()), default=None)
        # rows come before timers: a horizon that has passed closes the decision first
        closed = self.close_passed(held, watermark)
        marked: dict[int, set] = {}
        horizons: dict = {}
        late: dict = {}
        for batch in rows:
            columns = ["id_text", "cell", "weight", "reported_us", "event_id", "outcome", "source", "horizon_us"]
            for id_, cell, weight, reported, event, outcome, source, horizon in zip(*(batch[c].tolist() for c in columns)):
                if id_ not in held:
                    if cell not in marked:
                        marked[cell] = set(self.marked(cell))
                    if id_ in marked[cell]:
                        late[id_] = late.get(id_, 0) + 1
                        continue
                event = [id_, cell, float(weight), int(reported), int(event), outcome, source, 1, None]
                best = held.get(id_)
                if best is not None:
                    event[7:] = best[7] + 1, best[8]
                if best is None or self.weighed(event) > self.weighed(best):
                    held[id_] = event
                    if event[8] is None:
                        horizons[id_] = int(horizon)
                else:
                    best[7] += 1
        for id_, horizon in horizons.items():
            # a horizon that has passed already fires with the next batch
            held[id_][8] = max(horizon // 1000, watermark + 1)
        self.keep(held, timer)
        yield from self.out(closed, [(id_, "late", None, None, None, n) for id_, n in late.items()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held()
        closed = self.close_passed(held, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))
        if closed:
            self.keep(held, expiredTimerInfo.getExpiryTimeInMs())
        yield from self.out(closed)

    @staticmethod
    def weighed(row: list) -> tuple:
        return (*row[2:5], row[5] or "", row[6] or "")

    @staticmethod
    def out(*parts: list[tuple]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if part:
                yield pd.DataFrame(part, columns=COLUMNS)

    def held(self) -> dict:
        """The open decisions of the part."""
        found = self.open.get()
        return {r[0]: r for r in json.loads(found[0])} if found else {}

    def marked(self, cell: int) -> list:
        found = self.marks.getValue((cell,))
        return json.loads(found[0]) if found else []

    def close_passed(self, held: dict, watermark: int) -> list[tuple]:
        """Take the decisions whose horizon has passed out of ``held``, mark them as closed, and give their rows."""
        passed = [r for r in held.values() if r[8] <= watermark]
        cells: dict[int, list] = {}
        for r in passed:
            del held[r[0]]
            cells.setdefault(r[1], []).append(r[0])
        for cell, ids in cells.items():
            self.marks.updateValue((cell,), (json.dumps(self.marked(cell) + ids),))
        return [(r[0], "closed", r[5], r[6], r[3], r[7]) for r in passed]

    def keep(self, held: dict, timer: int | None) -> None:
        """Write the open decisions, and put the part's timer, which stands at ``timer``, at the first of their horizons."""
        following = min((r[8] for r in held.values()), default=None)
        if timer is not None and timer != following:
            self.handle.deleteTimer(timer)
        if following is not None and timer != following:
            self.handle.registerTimer(following)
        if held:
            self.open.update((json.dumps(list(held.values())),))
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def stream_close_outcomes(events: DataFrame, delay: str = "0 seconds", closed: DataFrame | None = None) -> DataFrame:
    """Closing outcomes of a stream of accepted events with their decision's ``horizon_us``.

    Event time is ``reported_us``. A decision closes when the watermark passes
    its horizon; the winner is emitted once and events after that come out as
    rows of kind ``late``. Events of decisions in ``closed`` (decision_id), which
    have an outcome already, are ignored. Ids may be numbers or text.
    """
    timed = events.withColumn("reported_at", F.timestamp_micros("reported_us")).withWatermark("reported_at", delay)
    if closed is not None:
        timed = timed.join(closed.select("decision_id"), "decision_id", "left_anti")
    kind = events.schema["decision_id"].dataType.simpleString()
    place = F.pmod(F.xxhash64("decision_id"), F.lit(PARTS * CELLS))
    return (
        timed.select(
            F.col("decision_id").cast("string").alias("id_text"), F.floor(place / CELLS).cast("int").alias("part"),
            (place % CELLS).cast("int").alias("cell"),
            "weight", "reported_us", "event_id", "outcome", "source", "horizon_us", "reported_at",
        )
        .groupBy("part")
        .transformWithStateInPandas(
            statefulProcessor=OutcomeCloser(),
            outputStructType="decision_id string, kind string, outcome string, outcome_source string, "
            "outcome_us bigint, events bigint",
            outputMode="Append",
            timeMode="EventTime",
        )
        .withColumn("decision_id", F.col("decision_id").cast(kind))
    )


#: What a key's state gives out: its sums at its epoch, and its tail.
RECORD = "epoch bigint, clean double, total double, n_own_raw bigint, n_decisions bigint, failures bigint, clean_run bigint, late bigint"
HALF_LIFE_US = float(SETTINGS.age_halflife_days * DAY_US)


class TrustKeeper(StatefulProcessor):
    """Per key: evidence weights summed up at a fixed epoch, and the last decisions in order.

    A weight halves with every half-life, for all rows alike, so a sum at one time is the sum at another times one factor: rows are added at
    the key's epoch and never read again. The last ``trip_window`` decisions are kept as a list, the clean ones since the
    last wrong one as a number. A row that is older than a full list counts in the sums; of the tail it can change only the
    number of clean decisions since a wrong one, which then starts from the list, and it is counted as late.
    """

    def __init__(self, id_type: str):
        self.id_type = id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState(
            "sums", "epoch bigint, clean double, total double, raw bigint, n bigint, run bigint, late bigint"
        )
        self.wrong = handle.getValueState("wrong", f"ts_us bigint, id {self.id_type}")
        self.last = handle.getListState("last", f"ts_us bigint, id {self.id_type}, outcome string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums = list(self.sums.get()) if self.sums.exists() else None
        wrong = tuple(self.wrong.get()) if self.wrong.exists() else None
        last = [tuple(r) for r in self.last.get()] if self.last.exists() else []
        for batch in rows:
            sums, wrong, last = self.added(batch, sums, wrong, last)
        epoch, clean, total, raw, n, run, late = sums
        self.sums.update(tuple(sums))
        if wrong is not None:
            self.wrong.update(wrong)
        self.last.put(last)
        failures = sum(outcome == "wrong" for _, _, outcome in last)
        columns = [c.split()[0] for c in RECORD.split(", ")]
        yield pd.DataFrame([(*key, epoch, clean, total, raw, n, failures, run, late)], columns=[*TRUST_KEYS, *columns])

    @staticmethod
    def added(batch: pd.DataFrame, sums: list | None, wrong: tuple | None, last: list[tuple]) -> tuple[list, tuple | None, list[tuple]]:
        """State after the rows of ``batch``."""
        seen = batch["seen_us"].to_numpy(np.int64)
        epoch, clean, total, raw, n, run, late = sums or [int(seen.max()), 0.0, 0.0, 0, 0, 0, 0]
        labelled = batch["outcome"].isin(OUTCOMES).to_numpy()
        is_clean, is_wrong = (batch["outcome"] == "clean").to_numpy(), (batch["outcome"] == "wrong").to_numpy()
        weight = np.where(labelled, batch["weight"].to_numpy(float) * np.exp2((seen - epoch) / HALF_LIFE_US), 0.0)
        rows = list(zip(batch["ts_us"].tolist(), batch["id"].tolist(), batch["outcome"].tolist()))
        full = last[0][:2] if len(last) == SETTINGS.trip_window else None
        behind = sum(r[:2] < full for r in rows) if full else 0
        newest = heapq.nlargest(SETTINGS.trip_window, rows + last, key=lambda r: r[:2])[::-1]
        here = max((r[:2] for r, w in zip(rows, is_wrong) if w), default=None)
        if here is not None and (wrong is None or here > wrong):
            wrong = here
            run = sum(r[2] == "clean" and r[:2] > wrong for r in rows + last)
        else:
            run += sum(bool(c) and (wrong is None or r[:2] > wrong) for r, c in zip(rows, is_clean))
        sums = [
            epoch, clean + float(weight[is_clean].sum()), total + float(weight.sum()), raw + int(labelled.sum()), n + len(batch), run,
            late + behind,
        ]
        return sums, wrong, newest

    def close(self) -> None:
        pass


def trust_records(decisions: DataFrame) -> DataFrame:
    """A stream of decisions as a stream of their keys' records (``RECORD``), after every batch for the keys in it."""
    rows = earning(decisions).select(
        *TRUST_KEYS, "ts_us", "id", "outcome", ledger.source_weight(F.col("source")).alias("weight"),
        ledger.observed_at(F.col("outcome_us"), F.col("ts_us")).alias("seen_us"),
    )
    keys = ", ".join(f"{k} string" for k in TRUST_KEYS)
    return rows.groupBy(*TRUST_KEYS).transformWithStateInPandas(
        statefulProcessor=TrustKeeper(decisions.schema["id"].dataType.simpleString()),
        outputStructType=f"{keys}, {RECORD}", outputMode="Update", timeMode="None",
    )


def stream_trust(decisions: DataFrame, folder: str, as_of_us: int) -> None:
    """Keep trust current: each micro-batch updates the state of the keys it touches and upserts their rows.

    No history is read: the state has all that trust needs (``TrustKeeper``). ``as_of_us`` should not come before the
    outcomes that are read. Untouched rows keep their snapshot.
    """
    root = f"{folder}/trust"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # a key's state gives out one row a batch
        aged = F.pow(F.lit(0.5), (F.lit(as_of_us) - F.col("epoch")) / F.lit(HALF_LIFE_US))
        record = batch.withColumns({"n_clean": F.col("clean") * aged, "n_total": F.col("total") * aged})
        new = trust_rows(record.withColumns({"k_eff": F.col("n_clean"), "n_eff": F.col("n_total")}), as_of_us)
        earlier = [s for s in snapshots(spark, root) if s < batch_id]
        if earlier:
            new = upsert_trust(spark.read.parquet(f"{root}/snapshot={earlier[-1]}"), new)
        write_snapshot(new, root, batch_id)

    drain_batches(trust_records(decisions), handle, folder, mode="update")


def stream_drift_histogram(
    decisions: DataFrame, edges: DataFrame, keys: Sequence[str], value: str, delay: str, width: str = "1 day",
    bins: int = SETTINGS.bins,
) -> DataFrame:
    """Per key and tumbling window the counts on the reference's fixed edges, as a stream.

    ``edges`` has one small array per key; keys without one are counted all the same. Windows come out once, when the
    watermark has passed them; state is one row of counters per key and window.
    """
    slot = drift.bucket(F.col(value), F.col("edges"), bins)
    rows = (
        decisions.withColumn("at", F.timestamp_micros("ts_us"))
        .withWatermark("at", delay)
        .join(edges, list(keys), "left")
        .withColumn("_b", slot)
    )
    return (
        rows.groupBy(F.window("at", width), *keys)
        .agg(*[F.count(F.when(F.col("_b") == b, 1)).alias(f"_c{b}") for b in range(bins)])
        .withColumn("window_us", F.unix_micros("window.start"))
        .drop("window")
    )


def drift_of_histogram(histograms: DataFrame, reference: DataFrame, keys: Sequence[str], bins: int = SETTINGS.bins) -> DataFrame:
    """PSI and verdict per window from streamed counts and the reference's counts (``_r0`` ..)."""
    return drift.against_reference(histograms, reference, keys, "window_us", bins)
