"""Language-model scores by prediction by partial matching, with word counts beside them.

A text is a stream of bytes: its words (A-Z lowered), each followed by one space, and an end. The model is a trie of byte
contexts: the bytes of the stream before a byte, at most ``ORDER`` of them, over word boundaries; a space stands before the
stream. It is trained on all training texts. A byte is predicted in its longest context that training has seen; where the
context has never led to this byte, an escape goes to the context that is one byte shorter, and the bytes that the
longer context knows are excluded there. Escape estimation is method C: a context with q different bytes in n
occurrences escapes with q / (n + q). Below the empty context all bytes not excluded are equally likely, so every
text has a probability, and the probabilities of all texts sum to one at most.

The trie is never whole in one place. A task cuts its rows into batches of bounded size and writes them with the
distinct n-grams and words of the batch and their training counts. A word is asked for once a batch: it is stored with its
count and the batches that have it, and the answers are read from there. Counts of n-grams are combined on the map side,
so a common one costs a row a task. An n-gram is then looked up once for the corpus, in groups by its last three context
bytes: all contexts of three bytes and more of an n-gram lie in its group, and groups follow the number of n-grams. The
orders below are one table of at most 2**24 rows (n-grams of three bytes), which is broadcast. Every batch is answered the
code lengths of its n-grams and the counts of its words, each once, and adds them up over its texts.

Defined cases: a null or empty text has no words and is scored for its end; without training texts all bytes are
equally likely and no word is known; a repeated row counts again in training if its id says so; ids may be null (a
null id is in training if ``learn`` is true for it). Extra columns are passed through; added columns replace columns
of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trustlake.llm.common import answered, bytes_or_empty, named_back, parts, renamed, stored

#: Longest context in bytes; contexts up to SHORT bytes are in the broadcast table.
ORDER, SHORT = 4, 2
#: Text bytes, distinct n-grams and distinct words of a batch, at which it closes; n-grams of a group, about.
BATCH_BYTES, BATCH_GRAMS, BATCH_WORDS, GROUP_GRAMS = 24 << 20, 1_500_000, 900_000, 500_000
#: Symbols: a word's bytes, the space after it, and the end of the text in the place of a word.
SPACE, END = 0x20, 0x0A
ADDED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("n_known", T.LongType(), False),
        T.StructField("log_counts", T.DoubleType(), False),
        T.StructField("score", T.DoubleType(), False),
    ]
)
#: Beside each row: its batch; in one row of each batch its n-grams and words with their training counts.
KEPT = T.StructType(
    [
        T.StructField("batch", T.LongType(), False),
        T.StructField("grams", T.ArrayType(T.LongType(), False)),
        T.StructField("gram_counts", T.ArrayType(T.LongType(), False)),
        T.StructField("words", T.ArrayType(T.BinaryType(), False)),
        T.StructField("word_counts", T.ArrayType(T.LongType(), False)),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def stream(words: list[bytes]) -> bytes:
    """What is predicted, after one space that is not."""
    return b" ".join([b"", *words, bytes([END])])


def grams(streams: list[bytes]) -> np.ndarray:
    """The n-gram of each predicted byte: its bytes, the predicted one last, and above them their number less one."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    lengths = np.fromiter(map(len, streams), np.int64, len(streams))
    first = np.cumsum(lengths) - lengths
    key = np.zeros(len(data), np.int64)
    for back in range(ORDER, -1, -1):
        key <<= 8
        key[back:] |= data[: max(0, len(data) - back)]
    width = np.full(len(data), ORDER, np.int64)
    for at in range(min(ORDER, int(lengths.max(initial=0)))):
        # a stream's byte number ``at`` has as many bytes before it
        place = first[lengths > at] + at
        width[place] = at
        key[place] &= (1 << 8 * (at + 1)) - 1
    key |= width << 8 * (ORDER + 1)
    return np.delete(key, first)


def _width(key: np.ndarray) -> np.ndarray:
    return key >> 8 * (ORDER + 1)


def _cut(key: np.ndarray, width: int) -> np.ndarray:
    """The n-gram with its last ``width`` context bytes and the predicted one."""
    return key & ((1 << 8 * (width + 1)) - 1)


class Level:
    """The n-grams of one order with their counts, and what their contexts sum up to."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, below: Level | None):
        self.keys, inverse = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(inverse, counts, len(self.keys))
        self.contexts, at = np.unique(self.keys >> 8, return_inverse=True)
        self.total = np.bincount(at, self.counts, len(self.contexts))
        self.kinds = np.bincount(at, minlength=len(self.contexts))
        # counts in the next shorter context of the bytes that this one knows
        self.excluded = np.zeros(len(self.contexts))
        if below is not None:
            width = below.width
            self.width = width + 1
            self.excluded = np.bincount(at, below.count_of(_cut(self.keys, width)), len(self.contexts))
        else:
            self.width = 0

    def count_of(self, keys: np.ndarray) -> np.ndarray:
        return _find(self.keys, self.counts, keys)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], 0.0)


def code_lengths(keys: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of the last byte of each n-gram; ``levels`` from order 0 up, all that the n-grams need."""
    width = _width(keys)
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    mass, kinds = np.zeros(len(keys)), np.zeros(len(keys))  # excluded counts and bytes
    for order in range(len(levels) - 1, -1, -1):
        level = levels[order]
        at = np.flatnonzero(open_ & (width >= order))
        short = _cut(keys[at], order)
        context = short >> 8
        total, q = _find(level.contexts, level.total, context), _find(level.contexts, level.kinds, context)
        seen = total > 0
        at, short, context, total, q = at[seen], short[seen], context[seen], total[seen], q[seen]
        n = level.count_of(short)
        new = q - kinds[at]
        whole = total - mass[at] + new
        found = n > 0
        out[at[found]] += np.log10(n[found] / whole[found])
        open_[at[found]] = False
        escapes = ~found & (new > 0)
        out[at[escapes]] += np.log10(new[escapes] / whole[escapes])
        missed = at[~found]
        mass[missed] = _find(level.contexts, level.excluded, context[~found])
        kinds[missed] = q[~found]
    out[open_] -= np.log10(256 - kinds[open_])
    return out


class Counted:
    """Sorted distinct n-grams with their counts, grown part by part."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct n-grams of a part."""
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        place = np.searchsorted(self.keys, keys)
        held = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        held[inside] = self.keys[place[inside]] == keys[inside]
        self.counts[place[held]] += counts[held]
        self.keys = np.insert(self.keys, place[~held], keys[~held])
        self.counts = np.insert(self.counts, place[~held], counts[~held])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams in order of first sight, and the place of each one's n-gram among them."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


class Batch:
    """What a batch of documents asks for."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.grams, self.words = Counted(), {}

    def add(self, texts: list[bytes], learn: np.ndarray) -> None:
        words = [words_of(t) for t in texts]
        streams = [stream(w) for w in words]
        self.size += sum(map(len, streams))
        keys, at = _distinct(grams(streams))
        counted = np.repeat(learn, [len(s) - 1 for s in streams])
        self.grams.add(keys, np.bincount(at[counted], minlength=len(keys)))
        known = self.words
        for row, learned in zip(words, learn):
            row.append(bytes([END]))
            if learned:
                for w in row:
                    known[w] = known.get(w, 0) + 1
            else:
                for w in row:
                    known.setdefault(w, 0)

    def full(self) -> bool:
        return self.size >= BATCH_BYTES or len(self.grams.keys) >= BATCH_GRAMS or len(self.words) >= BATCH_WORDS


def _batched(df: DataFrame, text: str, learn: str, kept: str) -> DataFrame:
    """``df`` with ``kept`` in place of ``learn``."""
    schema = T.StructType([*[f for f in df.schema if f.name != learn], T.StructField(kept, KEPT, False)])
    arrow = to_arrow_schema(schema)
    lists = [arrow.field(kept).type.field(i) for i in range(len(KEPT))]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = iter(range(TaskContext.get().partitionId() << 32, 1 << 62))
        batch, waiting = Batch(next(numbers)), None
        for part in parts(rows):
            if batch.full():
                yield with_batch(waiting, batch, last=True)
                batch, waiting = Batch(next(numbers)), None
            if waiting is not None:
                yield with_batch(waiting, batch)
            batch.add(bytes_or_empty(part.column(text)), np.array(part.column(learn).to_pylist(), bool))
            waiting = part
        if waiting is not None:
            yield with_batch(waiting, batch, last=True)

    def with_batch(part: pa.RecordBatch, batch: Batch, last: bool = False) -> pa.RecordBatch:
        """The rows with their batch; the first row of the last part of a batch gets what the batch asks for."""
        n = part.num_rows
        of_row = [pa.array(np.full(n, batch.number, np.int64))]
        asked = (batch.grams.keys, batch.grams.counts, list(batch.words), list(batch.words.values()))
        for field, values in zip(lists[1:], asked):
            of_row.append(pa.array([values if last and not i else None for i in range(n)], field.type))
        old = [c.cast(arrow.field(f.name).type) for f, c in zip(part.schema, part.columns) if f.name != learn]
        return pa.RecordBatch.from_arrays([*old, pa.StructArray.from_arrays(of_row, fields=lists)], schema=arrow)

    return df.mapInArrow(run, schema)


def _asked(rows: DataFrame, kept: str, what: str, key: str) -> DataFrame:
    """(batch, ``key``, n) of each batch."""
    of = F.col(kept)
    pairs = F.explode(F.arrays_zip(of[what].alias("k"), of[f"{key}_counts"].alias("n"))).alias("e")
    return rows.filter(of[what].isNotNull()).select(of["batch"].alias("batch"), pairs).select(
        "batch", F.col("e.k").alias(key), F.col("e.n").alias("n")
    )


def _short_levels(counts: DataFrame) -> list[Level]:
    """The levels up to SHORT context bytes from (gram, n): at most 256 ** (SHORT + 1) rows reach the driver."""
    width = F.least(F.shiftright("gram", 8 * (ORDER + 1)), F.lit(SHORT))
    cut = F.col("gram").bitwiseAND(F.lit((1 << 8 * (SHORT + 1)) - 1))
    rows = counts.filter("n > 0").groupBy(width.alias("width"), cut.alias("key")).agg(F.sum("n").alias("n")).toArrow()
    widths, key, n = (rows.column(c).to_numpy() for c in ("width", "key", "n"))
    levels: list[Level] = []
    for order in range(SHORT + 1):
        levels.append(Level(_cut(key[widths >= order], order), n[widths >= order], levels[-1] if levels else None))
    return levels


def _looked_up(rows: pa.Table, low: list[Level]) -> pa.Table:
    """(gram, asks, value) of a group of distinct n-grams."""
    keys, counts = rows.column("gram").to_numpy(), rows.column("n").to_numpy().astype(float)
    width, levels = _width(keys), list(low)
    for order in range(SHORT + 1, ORDER + 1):
        trained = (width >= order) & (counts > 0)
        levels.append(Level(_cut(keys[trained], order), counts[trained], levels[-1]))
    return pa.table({"gram": keys, "asks": rows.column("asks"), "value": code_lengths(keys, levels)})


def _added_up(texts: list[bytes], known: dict[bytes, int], keys: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """The added columns of texts, from the counts of all their words and the sorted n-grams' code lengths."""
    words = [words_of(t) for t in texts]
    streams = [stream(w) for w in words]
    found, at = _distinct(grams(streams))
    code = values[np.searchsorted(keys, found)][at]
    ends = np.cumsum([0] + [len(s) - 1 for s in streams])
    score = np.add.reduceat(code, ends[:-1])  # every stream predicts its end at least
    counts = [np.array([known[w] for w in (*row, bytes([END]))], np.int64) for row in words]
    n_tokens = np.fromiter(map(len, counts), np.int64, len(counts))
    n_known = np.fromiter((np.count_nonzero(c) for c in counts), np.int64, len(counts))
    logs = np.fromiter((np.log10(c + 1.0).sum() for c in counts), float, len(counts))
    return [n_tokens, n_known, logs, score]


def scored(df: DataFrame, learn: Column, text: str = "text") -> tuple[DataFrame, int, int]:
    """(``df`` with n_tokens, n_known, log_counts and score; training tokens; distinct training tokens).

    ``score`` is the model's log10 probability of the text; ``n_known`` counts the tokens that training has and
    ``log_counts`` sums log10(c + 1) over the tokens, c being the token's training count. ``learn`` is true for
    the training rows.
    """
    spark = df.sparkSession
    flag = next(n for n in map("learn{}".format, range(len(df.columns) + 1)) if n not in df.columns)
    rows, names = renamed(df.withColumn(flag, F.coalesce(learn, F.lit(False))))
    text, flag = names[text], names.pop(flag)
    rows = stored(_batched(rows, text, flag, "kept"), "batches", compression="zstd")

    asked_words, asked_grams = _asked(rows, "kept", "words", "word"), _asked(rows, "kept", "grams", "gram")
    # a word has a row in each batch at most, so no partial sums go ahead of the shuffle
    by_word = asked_words.repartition("word").groupBy("word")
    words = stored(by_word.agg(F.sum("n").alias("n"), F.collect_list("batch").alias("batches")), "words", compression="zstd")
    totals = words.filter("n > 0").agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens, distinct = totals[0] or 0, totals[1] or 0

    counts = stored(asked_grams.groupBy("gram").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("asks")), "n-grams")
    low = spark.sparkContext.broadcast(_short_levels(counts))
    groups = max(1, counts.count() // GROUP_GRAMS)
    context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * (SHORT + 1)) - 1))
    lengths = stored(
        counts.groupBy(F.pmod(F.xxhash64(context), F.lit(groups)).alias("group")).applyInArrow(
            lambda found: _looked_up(found, low.value), "gram long, asks long, value double"
        ),
        "code-lengths",
    )
    none = {"gram": F.lit(None).cast("long"), "value": F.lit(None).cast("double"), "word": F.lit(None).cast("binary"), "n": F.lit(None).cast("long")}
    columns = ["batch", *none]
    answers = (
        words.select(F.explode("batches").alias("batch"), "word", "n")
        .withColumns({c: none[c] for c in ("gram", "value")})
        .select(columns)
    ).unionByName(
        answered(asked_grams.drop("n"), lengths, "gram").withColumns({c: none[c] for c in ("word", "n")}).select(columns)
    )

    kept = T.StructType([f for f in rows.schema if f.name != "kept"])
    schema = T.StructType([*kept, *ADDED])
    arrow = to_arrow_schema(schema)

    def summed(docs: pa.Table, found: pa.Table) -> pa.Table:
        of_words, of_grams = found.filter(pc.is_valid(found.column("word"))), found.filter(pc.is_valid(found.column("gram")))
        known = dict(zip(of_words.column("word").to_pylist(), of_words.column("n").to_pylist()))
        of_grams = of_grams.sort_by("gram")
        keys, values = of_grams.column("gram").to_numpy(), of_grams.column("value").to_numpy()
        out = []
        for part in parts(docs.to_batches()):
            made = _added_up(bytes_or_empty(part.column(text)), known, keys, values)
            old = [part.column(f.name).cast(arrow.field(f.name).type) for f in kept]
            out.append(pa.RecordBatch.from_arrays([*old, *map(pa.array, made)], schema=arrow))
        return pa.Table.from_batches(out, schema=arrow)

    travelling = rows.withColumn("batch", F.col("kept.batch")).drop("kept")
    out = travelling.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(summed, schema)
    return named_back(out, names, ADDED.names), tokens, distinct
