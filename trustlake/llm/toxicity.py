"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a byte model of words: the probability of the next byte of a word given the
``ORDER - 1`` bytes before it (words are padded with spaces, so the start and the end of a word count). The highest
order is counted for each class and discounted; what is left goes to lower orders that are estimated from the
continuation counts of both classes together. So a rare expression is judged by the stem that it shares with
others, and where neither class has seen a context both fall back to the same counts and the difference is none.

Most words of a toxic text are ordinary, so its likelihood takes every word from the toxic model with probability
``SHARE`` and else from the ordinary one. A document's raw score is this log-likelihood less the ordinary one,
by word. A logistic curve turns it into a probability; it is fitted on raw scores of training documents by models
that have not seen them (``FOLDS`` folds).

The models are fitted on at most ``MAX_DOCS`` labelled documents of each class (those with the smallest hashes), so
what is broadcast is bounded; they are weighted back to the labelled rows' shares. All texts are scored whole.

Defined cases: a null or empty text, or one without training data, has raw score 0 and so the curve's value there;
a label that is null takes no part; several labels of one document count as toxic if one is; labelled rows without
a document are ignored; if a class has no training document every score is the share of toxic labels (0 without
labels). Repeated rows count each. Other columns are passed through; ``score`` replaces a column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlake.llm.common import adding, bytes_or_empty, named_back, renamed

#: Bytes of an n-gram, and labelled documents of each class that the models are fitted on at most.
ORDER, MAX_DOCS = 6, 20_000
#: Taken from every class count; larger than usual, as few counts of a rare stem should not tell the classes apart.
DISCOUNT = 3.0
#: Share of words of a toxic text that its own model is asked for.
SHARE = 0.05
#: Words whose values a task remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
EDGE = b".,;:!?\"'()[]{}*_-"
FOLDS = 5
COUNTS = [f"n{fold}{toxic}" for fold in range(FOLDS) for toxic in (0, 1)]


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram as a number, index of its word) of all words; a word of n bytes has n + 1."""
    pad = b" " * (ORDER - 1)
    parts = [pad + w.strip(EDGE) + b" " for w in words]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) - (ORDER - 1)
    of = np.repeat(np.arange(len(parts)), lengths)
    at = np.arange(len(of)) + (of + 1) * (ORDER - 1)
    key = np.zeros(len(of), np.int64)
    for back in range(ORDER - 1, -1, -1):
        key = key << 8 | data[at - back]
    return key, of


class Ratio:
    """log P(word | toxic text) - log P(word | ordinary text) from the n-grams' counts in the two classes."""

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, discount: float = DISCOUNT):
        seen = (toxic + ordinary) > 0
        order = np.argsort(keys[seen])
        self.keys = keys[seen][order]
        counts = [c[seen][order].astype(float) for c in (toxic, ordinary)]
        self.contexts, at = np.unique(self.keys >> 8, return_inverse=True)
        shared = _interpolated(self.keys, counts[0] + counts[1], _continued(self.keys))
        logs, rests = [], []
        for c in counts:
            total = np.bincount(at, c, len(self.contexts))
            # the taken mass of a context goes to the shared model; all of it where the class has not been there
            rest = np.where(total > 0, np.bincount(at, np.minimum(c, discount)) / np.maximum(total, 1), 1.0)
            own = np.maximum(c - discount, 0) / np.maximum(total, 1)[at]
            logs.append(np.log(own + rest[at] * shared))
            rests.append(np.log(rest))
        self.known, self.unknown = logs[0] - logs[1], rests[0] - rests[1]

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Ratio:
        """From ``vars`` of another one; plain arrays are broadcast, as executors need not have this package."""
        found = cls.__new__(cls)
        found.__dict__.update(arrays)
        return found

    def of_words(self, words: list[bytes]) -> list[float]:
        key, of = grams(words)
        value = _at(self.contexts, self.unknown, key >> 8, 0.0) if len(key) else np.empty(0)
        ratio = np.bincount(of, _at(self.keys, self.known, key, value), minlength=len(words))
        return np.log1p(SHARE * np.expm1(np.minimum(ratio, 100.0))).tolist()


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(otherwise, wanted.shape)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], otherwise)


def _interpolated(keys: np.ndarray, n: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of each n-gram from its count and its probability in the next lower order."""
    _, at = np.unique(keys >> 8, return_inverse=True)
    once, twice = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    total, kinds = np.bincount(at, n), np.bincount(at)
    return np.maximum(n - discount, 0) / total[at] + (discount * kinds / total)[at] * lower


def _continued(keys: np.ndarray, width: int = ORDER) -> np.ndarray:
    """Probability of each distinct n-gram's last byte given all but its first, from the bytes that precede."""
    if width == 1:
        return np.full(len(keys), 1 / 256)
    short, at, n = np.unique(keys & ((1 << 8 * (width - 1)) - 1), return_inverse=True, return_counts=True)
    return _interpolated(short, n.astype(float), _continued(short, width - 1))[at]


def sample(labels: DataFrame, doc_id: str, toxic: str, learn: Column, most: int = MAX_DOCS) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, fold) of at most ``most`` documents of each class, by hash; and how many the classes have."""
    rows = (
        labels.filter(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull() & learn)
        .groupBy(F.col(doc_id).alias("_label_id"))
        .agg(F.max((F.col(toxic) > 0).cast("int")).alias("_toxic"))
    )
    sizes = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    draw = F.xxhash64("_label_id")
    parts = [rows.filter(F.col("_toxic") == c).orderBy(draw, "_label_id").limit(most) for c in (0, 1)]
    return parts[0].unionByName(parts[1]).withColumn("_fold", F.pmod(F.xxhash64("_label_id", F.lit(1)), F.lit(FOLDS)).cast("int")), sizes


def _counted(texts: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """N-grams of the training texts with their counts by fold and class; as many as a bounded sample has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: dict[bytes, int] = {}
            words, columns = [], []
            folds = zip(bytes_or_empty(batch.column("text")), batch.column("_fold").to_pylist(), batch.column("_toxic").to_pylist())
            for text, fold, toxic in folds:
                found = text.lower().split()
                words.extend(of.setdefault(w, len(of)) for w in found)
                columns.extend([2 * fold + toxic] * len(found))
            counts = np.bincount(
                np.array(words, np.int64) * len(COUNTS) + np.array(columns, np.int64), minlength=len(COUNTS) * len(of)
            )
            counts = counts.reshape(-1, len(COUNTS))
            key, at = grams(list(of))
            distinct, inverse = np.unique(key, return_inverse=True)
            arrays = [np.bincount(inverse, counts[at, i], minlength=len(distinct)).astype(np.int64) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (distinct, *arrays)], names=["key", *COUNTS])

    found = texts.mapInArrow(run, ", ".join(f"{c} long" for c in ("key", *COUNTS)))
    rows = found.groupBy("key").agg(*[F.sum(c).alias(c) for c in COUNTS]).toArrow()
    return rows.column("key").to_numpy(), {c: rows.column(c).to_numpy() for c in COUNTS}


def raw_scores(df: DataFrame, models: list[Ratio], text: str, out: str, fold: str | None = None) -> DataFrame:
    """``df`` with ``out``: by word, the difference of the log-likelihoods; the row's ``fold`` names the model."""
    model = df.sparkSession.sparkContext.broadcast([vars(m) for m in models])

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        ratios = [Ratio.of(arrays) for arrays in model.value]
        remembered: list[dict[bytes, float]] = [{} for _ in ratios]
        for batch in batches:
            rows = [t.lower().split() for t in bytes_or_empty(batch.column(text))]
            folds = batch.column(fold).to_pylist() if fold else [0] * len(rows)
            for i, known in enumerate(remembered):
                if len(known) > REMEMBERED:
                    known.clear()
                new = list(set(chain.from_iterable(r for r, f in zip(rows, folds) if f == i)).difference(known))
                known.update(zip(new, ratios[i].of_words(new)))
            values = [sum(map(remembered[f].__getitem__, r)) / len(r) if r else 0.0 for r, f in zip(rows, folds)]
            yield batch, [pa.array(values, pa.float64())]

    return adding(df, T.StructType([T.StructField(out, T.DoubleType(), False)]), columns)


def fitted_curve(raw: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve by Newton's method; a little ridge keeps separable scores finite."""
    scale = float(np.std(raw)) or 1.0
    x = np.stack((raw / scale, np.ones(len(raw))), axis=1)
    share = np.average(toxic, weights=weight)
    beta, ridge = np.array([1.0, np.log(share / (1 - share))]), np.diag([1e-3, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        slope = x.T @ (weight * (toxic - p)) - ridge @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, slope)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]) / scale, float(beta[1])


def scored(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    out: str = "score",
) -> DataFrame:
    """``docs`` with ``out``, the probability that a text is toxic; ``learn`` is true for labels to learn from."""
    chosen, sizes = sample(labels, doc_id, toxic, learn)
    total = sum(sizes.values())
    if len(sizes) < 2:
        return docs.withColumn(out, F.lit(float(sizes.get(1, 0)) / total if total else 0.0))
    # at most 2 * MAX_DOCS ids are broadcast
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text")).join(
        F.broadcast(chosen), F.col("_doc") == F.col("_label_id")
    ).select("text", "_toxic", "_fold")
    keys, n = _counted(texts)
    sums = [sum(n[f"n{f}{c}"] for f in range(FOLDS)) for c in (1, 0)]
    # a model for each fold from the others, and one from all
    others = [Ratio(keys, sums[0] - n[f"n{f}1"], sums[1] - n[f"n{f}0"]) for f in range(FOLDS)]
    rows = raw_scores(texts, others, "text", "_raw", "_fold").select("_raw", "_toxic").toArrow()
    raw, truth = rows.column("_raw").to_numpy(), rows.column("_toxic").to_numpy().astype(float)
    if len(set(truth.tolist())) < 2:
        return docs.withColumn(out, F.lit(float(sizes.get(1, 0)) / total))
    drawn = {c: np.count_nonzero(truth == c) for c in (0, 1)}
    weight = np.where(truth == 1, sizes[1] / drawn[1], sizes[0] / drawn[0])
    slope, intercept = fitted_curve(raw, truth, weight / weight.mean())
    whole = Ratio(keys, *sums)
    value = 1 / (1 + F.exp(-(F.lit(slope) * F.col("_raw") + F.lit(intercept))))
    rows, names = renamed(docs)
    return named_back(raw_scores(rows, [whole], names[text], "_raw").withColumn(out, value), names, [out])
