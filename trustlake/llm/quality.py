"""Document quality rules with a verdict for each host.

Every document is measured on its whole text and held against fixed rules. The failures are then summed by host,
and each host's failure rate is shrunk towards the rate of all hosts with a beta prior that is fitted to the
hosts by the method of moments, so a host with few documents is not judged by them alone. A host fails by the size of
its effect: if its odds of a failure are at least ``HOST_ODDS`` times those of all hosts, or its rate is above one half;
how many documents it has matters to the shrinkage only. The verdicts go back to the documents in a join on the host. Soft
rules have two limits: beyond the wide one a document is rejected on every host, beyond the narrow one on hosts that
fail. A document that breaks no rule is kept on every host.

Hard rules: fewer than ``MIN_WORDS`` words; more than half of the words in repeated 3-word windows.
Soft rules, narrow and wide: mean word length outside ``WORD_LENGTH``; more than ``MAX_SYMBOLS`` symbols a word; more than
``MAX_DUP_LINES`` of the lines with a word equal to an earlier line. Hosts are rated by the hard rules and the narrow limits.

Defined cases: a null or empty text has no words, so it fails; the null host is a host of its own; repeated rows
count each; an empty table gives no rows. Added columns replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlake.llm.common import adding, bytes_or_empty, named_back, renamed

MIN_WORDS, MAX_REPEAT = 50, 0.5
#: Narrow limits, and wide ones.
WORD_LENGTH, MAX_SYMBOLS, MAX_DUP_LINES = ((2.0, 16.0), (1.5, 24.0)), (0.2, 0.4), (0.3, 0.6)
#: A host fails if its shrunken failure rate is above this, or has this many times the odds of the rate of all.
HOST_LIMIT, HOST_ODDS = 0.5, 2.0
SYMBOLS = b"#*$%&|<>"
#: Bytes that start a code point.
STARTS = bytes(b for b in range(256) if b & 0xC0 != 0x80)

MEASURES = T.StructType(
    [
        T.StructField(n, T.LongType(), False)
        for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    ]
)


def _measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    words = text.split()
    together = b"".join(words)
    # UTF-8 continuation bytes do not start a code point
    chars = len(together) - len(together.translate(None, STARTS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words in 3-word windows that the text holds twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    once: set[tuple] = set()
    again: set[tuple] = set()
    for w in windows:
        if w in once:
            again.add(w)
        else:
            once.add(w)
    if not again:
        return 0
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if w in again:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measures of its whole texts."""

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            rows = [_measure(t) for t in bytes_or_empty(batch.column(text))]
            yield batch, [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]

    return adding(df, MEASURES, columns)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT) * F.col("n_words"))


def soft_failed(wide: bool) -> Column:
    """A soft rule, by its narrow or its wide limits."""
    low, high = WORD_LENGTH[wide]
    length = (F.col("word_chars") < low * F.col("n_words")) | (F.col("word_chars") > high * F.col("n_words"))
    symbols = F.col("n_symbols") > MAX_SYMBOLS[wide] * F.col("n_words")
    lines = F.col("n_dup_lines") > MAX_DUP_LINES[wide] * F.col("n_lines")
    return length | symbols | lines


def host_rates(rows: DataFrame, host: str, failed: str) -> DataFrame:
    """(_host, n_docs, n_failed, rate, bad) of each host, see ``rated``."""
    by_host = rows.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed")
    )
    return rated(by_host)


def rated(by_host: DataFrame) -> DataFrame:
    """``by_host`` (_host, n_docs, n_failed) with rate, the failure rate shrunk with the beta prior of all hosts, and bad.

    With m the mean and v the variance of the hosts' rates (hosts weigh by their documents), v is the prior's
    variance plus the part that chance alone gives, m (1 - m) K / N for K hosts and N documents; the prior's
    strength is m (1 - m) / (v - chance) - 1, at least 1. If the hosts differ no more than by chance, every
    host has the rate m. ``bad`` are the hosts with a rate above ``HOST_LIMIT``, and those whose odds of a failure are
    ``HOST_ODDS`` times those of the rate m or more.
    """
    sums = by_host.agg(
        F.sum("n_docs").alias("n"),
        F.sum("n_failed").alias("f"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("sq"),
    ).first()
    m, strength = prior(sums.n or 0, sums.f or 0, sums.k or 0, sums.sq or 0.0)
    rate = F.lit(m) if strength is None else (F.col("n_failed") + strength * m) / (F.col("n_docs") + strength)
    # odds of the rate over odds of m, without division
    worse = F.col("rate") * (1 - m) >= HOST_ODDS * m * (1 - F.col("rate"))
    bad = (F.col("rate") > HOST_LIMIT) | (worse & (F.col("rate") > m))
    return by_host.select("_host", "n_docs", "n_failed", rate.alias("rate")).withColumn("bad", bad)


def prior(n: int, failed: int, hosts: int, squares: float) -> tuple[float, float | None]:
    """Mean and strength (alpha + beta) of the prior; no strength if the hosts differ by chance only."""
    if not n:
        return 0.0, None
    m = failed / n
    within = m * (1 - m)
    beyond = squares / n - m * m - within * hosts / n
    return m, max(within / beyond - 1, 1.0) if beyond > 0 else None


def judged(rows: DataFrame, host: str = "source") -> DataFrame:
    """``rows`` with base_failed, host_rate and kept. ``rows`` comes from ``measured`` and is read twice."""
    own, names = renamed(rows)
    measures = {n: F.col(names[n]) for n in MEASURES.names}
    marked = own.withColumns(measures).withColumns(
        {"base_failed": base_failed(), "narrow": soft_failed(False), "wide": soft_failed(True)}
    )
    failed = marked.withColumn("failed", F.col("base_failed") | F.col("narrow"))
    hosts = host_rates(failed, names[host], "failed").select("_host", F.col("rate").alias("host_rate"), "bad")
    out = failed.join(hosts, F.col(names[host]).eqNullSafe(F.col("_host")), "left").withColumn(
        "kept", ~F.col("base_failed") & ~F.col("wide") & ~(F.col("narrow") & F.col("bad"))
    )
    return named_back(out, names, ["base_failed", "host_rate", "kept"])
