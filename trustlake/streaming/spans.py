"""Scoring a reply while it arrives, span by span."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trustlake.config import DAY_US, SETTINGS
from trustlake.functions import text as tx

SPAN_END = re.compile(r"[.!?]\s*$")  # fixed value: the end of a sentence
SPAN = "response_id string, span_no int, span string, is_last boolean"


class SpanCutter(StatefulProcessor):
    """Per response: collect chunks, cut a span at a sentence end or at 32 words, drain at the end.

    The state is the unfinished span, its number, the next chunk number, and the
    chunks that came before their turn; input is taken batch by batch, so neither
    grows with the reply. A chunk that comes again is known by its number and
    dropped. An ended response keeps a mark, so a repeated delivery opens nothing.
    A response that sends nothing for ``idle_ms`` of event time is drained as it
    is; that, like an end, leaves the mark, which goes after ``idle_ms`` more: later
    repeats lie behind the watermark and do not arrive. Only the cutting happens
    here; scoring is done by column expressions on the emitted spans.
    """

    def __init__(self, words: int = SETTINGS.flush_tokens, idle_ms: int = 600_000):
        self.words, self.idle_ms = words, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState(
            "open", "buffer string, span_no int, expected int, waiting int, ended boolean, fires_ms bigint"
        )
        self.early = handle.getMapState("early", "seq int", "chunk string, is_last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = ("", 0, 0, 0, False, 0)
        buffer, number, expected, waiting, ended, fires = self.open.get() if self.open.exists() else start
        if ended:
            return
        early = {k[0]: (v[0], v[1]) for k, v in self.early.iterator()} if waiting else {}
        latest = 0
        for batch in rows:
            spans: list[tuple[str, int, str, bool]] = []
            latest = max(latest, int(batch["sent_us"].max()) // 1000)
            early.update(
                (int(seq), (chunk or "", bool(last)))
                for seq, chunk, last in zip(batch["seq"], batch["chunk"], batch["is_last"])
                if seq >= expected and not ended
            )
            while expected in early and not ended:
                chunk, last = early.pop(expected)
                expected += 1
                buffer += chunk
                if last:
                    spans.append((key[0], number, buffer, True))
                    ended = True
                elif SPAN_END.search(buffer) or len(buffer.split()) >= self.words:
                    if buffer.strip():
                        spans.append((key[0], number, buffer, False))
                        number += 1
                        buffer = ""
            if spans:
                yield pd.DataFrame(spans, columns=["response_id", "span_no", "span", "is_last"])
        if waiting:
            self.early.clear()
        if ended:
            buffer, early = "", {}
        for seq, value in early.items():
            self.early.updateValue((seq,), value)
        again = max(latest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        if again > fires:
            if fires:
                self.handle.deleteTimer(fires)
            self.handle.registerTimer(again)
            fires = again
        self.open.update((buffer, number, expected, len(early), ended, fires))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.open.exists():
            return
        buffer, number, expected, waiting, ended, _ = self.open.get()
        if ended:
            self.open.clear()
            return
        early = sorted((k[0], v[0]) for k, v in self.early.iterator()) if waiting else []
        self.early.clear()
        again = expiredTimerInfo.getExpiryTimeInMs() + self.idle_ms
        self.handle.registerTimer(again)
        self.open.update(("", number, expected, 0, True, again))
        rest = buffer + "".join(chunk for _, chunk in early)
        if rest.strip():
            yield pd.DataFrame([(key[0], number, rest, False)], columns=["response_id", "span_no", "span", "is_last"])

    def close(self) -> None:
        pass


Scorer = Callable[[Column], Column]


def stream_spans(chunks: DataFrame, scorers: dict[str, Scorer] | None = None, delay: str = "10 minutes") -> DataFrame:
    """Span rows with their scores from a stream of chunks (response_id, seq, chunk, is_last, sent_us).

    Chunks are numbered 0, 1, .. per response; one that arrives before its turn
    waits in the state. The last chunk of a response carries ``is_last`` and closes it.
    Chunks may arrive up to ``delay`` of event time late. ``scorers`` maps score columns to functions of the span column; by default the
    secret and the personal-data score.
    """
    timed = chunks.withColumn("sent_at", F.timestamp_micros("sent_us")).withWatermark("sent_at", delay)
    spans = (
        timed.select("response_id", "seq", "chunk", "is_last", "sent_us", "sent_at")
        .groupBy("response_id")
        .transformWithStateInPandas(
            statefulProcessor=SpanCutter(), outputStructType=SPAN, outputMode="Append", timeMode="EventTime"
        )
    )
    chosen = scorers or {"secret_score": tx.secret_score, "pii_score": tx.pii_score}
    return spans.withColumns({name: score(F.col("span")) for name, score in chosen.items()})


def response_scores(spans: DataFrame) -> DataFrame:
    """Per response the largest score of any span.

    A measured span outweighs an unmeasured one, as ``max`` ignores NULL;
    ``pii_unmeasured`` still tells that some span had no answer.
    """
    return spans.groupBy("response_id").agg(
        F.max("secret_score").alias("secret_score"),
        F.max("pii_score").alias("pii_score"),
        F.max(F.col("pii_score").isNull().cast("int")).alias("pii_unmeasured"),
        F.count(F.when(F.col("span").rlike(r"\S"), 1)).alias("spans"),
        F.max("is_last").alias("complete"),
    )


def chunked(texts: DataFrame, key: str, text: str, words: int = 4, start_us: int = DAY_US) -> DataFrame:
    """Cut whole texts into chunks of a few words, as a provider would send them, one a millisecond from ``start_us``."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"(?:\S+\s*){{1,{words}}}|\s+"), F.lit(0))
    cut = texts.select(F.col(key).cast("string").alias("response_id"), pieces.alias("_p")).select(
        "response_id",
        F.when(F.size("_p") == 0, F.array(F.lit(""))).otherwise(F.col("_p")).alias("_p"),
        F.greatest(F.size("_p"), F.lit(1)).alias("_n"),
    )
    rows = cut.select("response_id", "_n", F.posexplode("_p").alias("seq", "chunk"))
    sent = F.lit(start_us) + F.col("seq").cast("bigint") * 1000
    return rows.withColumns({"is_last": F.col("seq") == F.col("_n") - 1, "sent_us": sent}).drop("_n")
