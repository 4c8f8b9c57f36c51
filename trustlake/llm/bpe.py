"""Byte-level BPE encoding and decoding of whole texts.

The ranks of a ``.tiktoken`` file (one ``base64(token) rank`` pair a line) are turned into a vocabulary and a
merge list of the ``tokenizers`` library on the driver, once. The serialised tokenizer (a few MB, bounded by the
vocabulary) is broadcast; every task opens it and encodes Arrow batches of texts. Bytes are mapped to printable
characters for the vocabulary, as that library wants them, and mapped back for decoding and for offsets.

Decoding looks every id up in a table of byte strings and joins the bytes, so characters that were split over
several ids come back whole; ``decoded_text`` replaces what is not valid UTF-8 (only ids that no text gives).
Special tokens are never made: their strings in a text are ordinary text.

Defined cases: a null text is the empty text; an empty text has no ids; null ids decode to empty bytes; an id
outside the vocabulary raises ``ValueError``. Rows are independent, so repeated rows and ties need no rule, and
all other columns are passed through (a column that has the name of an added one is replaced).
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlake.llm.common import adding, text_or_empty


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank; the file is read on the driver only."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def byte_characters() -> list[str]:
    """The printable character of each byte: printable Latin-1 as it is, the others from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(moved)) for b in range(256)]


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """For each token of two bytes or more, the two tokens that the lower ranks leave of its bytes, by rank.

    A token of which they leave more parts has no merge: it is the token of a whole match only, which is looked up first.
    """
    found = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = _merge(token, ranks, rank)
            if len(parts) == 2:
                found.append((parts[0], parts[1]))
    return found


def _merge(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The parts of ``piece`` after every merge of a rank under ``below``, lowest rank first, then leftmost."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A serialised tokenizer with these ranks as merges, applied to each match of ``pattern`` separately."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"bytes without a rank: {missing}")
    of = byte_characters()
    show = lambda token: "".join(of[b] for b in token)
    merges = [(show(a), show(b)) for a, b in merges_of(ranks)]
    tokenizer = Tokenizer(models.BPE(vocab={show(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return tokenizer.to_str()


#: Pieces whose ids a task remembers; beyond it the memory starts anew, which changes the speed only.
REMEMBERED = 300_000


class _Pieces(dict):
    """A match of the pattern -> its ids as little-endian int32 bytes; each distinct match is merged once."""

    def __init__(self, tokenizer):
        self.tokenize = tokenizer.model.tokenize
        self.shown = dict(enumerate(byte_characters()))

    def __missing__(self, piece: str) -> bytes:
        # bytes as Latin-1 characters, then as the printable characters of the vocabulary
        mapped = piece.encode().decode("latin-1").translate(self.shown)
        ids = array("i", [t.id for t in self.tokenize(mapped)]).tobytes()
        self[piece] = ids
        return ids


def _lists(rows: list[bytes]) -> pa.Array:
    """Arrow lists of int32 from each row's bytes."""
    ends = np.cumsum([0, *map(len, rows)]) // 4
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(rows))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _opened(model: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_str(model)


def _encoder(model: str, pattern: str) -> Callable[[pa.Array], pa.Array]:
    """In a task: ids of texts."""
    import regex

    known, pieces_of = _Pieces(_opened(model)), regex.compile(pattern).findall

    def encoded(texts: pa.Array) -> pa.Array:
        rows = []
        for t in text_or_empty(texts):
            rows.append(b"".join(map(known.__getitem__, pieces_of(t))))
            if len(known) > REMEMBERED:
                known.clear()
        return _lists(rows)

    return encoded


def _decoder(shown: dict[int, str]) -> Callable[[pa.Array], pa.Array]:
    """In a task: bytes of ids, by the vocabulary in its printable characters, reversed."""
    back = {c: b for b, c in enumerate(byte_characters())}
    bytes_of = {r: bytes(map(back.__getitem__, s)) for r, s in shown.items()}

    def decoded(ids: pa.Array) -> pa.Array:
        out = []
        for row in ids:
            known = row.values.to_numpy(zero_copy_only=False).tolist() if row.is_valid else []
            try:
                out.append(b"".join(map(bytes_of.__getitem__, known)))
            except KeyError as unknown:
                raise ValueError(f"id {unknown} is not in the vocabulary") from None
        return pa.array(out, pa.binary())

    return decoded


def _shown(ranks: dict[bytes, int]) -> dict[int, str]:
    of = byte_characters()
    return {r: "".join(of[b] for b in t) for t, r in ranks.items()}


IDS = T.ArrayType(T.IntegerType(), False)


def encode(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", offsets: str | None = None
) -> DataFrame:
    """``df`` with ``ids`` (array<int>) of its whole texts and, if named, ``offsets``.

    ``offsets`` is an array of (start, end) structs in code points of the text, one for each id; ids that
    share a character share its offsets.
    """
    model = df.sparkSession.sparkContext.broadcast(tokenizer_json(ranks, pattern))
    added = T.StructType([T.StructField(ids, IDS, False)])
    ids_type, span_type = pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    if offsets:
        span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
        added.add(offsets, T.ArrayType(span, False), False)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        if not offsets:
            encoded = _encoder(model.value, pattern)
            for batch in batches:
                yield batch, [encoded(batch.column(text))]
            return
        tokenizer = _opened(model.value)
        for batch in batches:
            found = tokenizer.encode_batch(text_or_empty(batch.column(text)), add_special_tokens=False)
            spans = [[{"start": a, "end": b} for a, b in e.offsets] for e in found]
            yield batch, [pa.array([e.ids for e in found], ids_type), pa.array(spans, span_type)]

    return adding(df, added, columns)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``df`` with ``data``, the bytes that its ids stand for."""
    table = df.sparkSession.sparkContext.broadcast(_shown(ranks))

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        decoded = _decoder(table.value)
        for batch in batches:
            yield batch, [decoded(batch.column(ids))]

    return adding(df, T.StructType([T.StructField(data, T.BinaryType(), False)]), columns)


def round_trip(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", data: str = "decoded"
) -> DataFrame:
    """``df`` with its texts' ids and the bytes decoded from those ids: ``encode`` and ``decode`` in one Python worker."""
    context = df.sparkSession.sparkContext
    model, table = context.broadcast(tokenizer_json(ranks, pattern)), context.broadcast(_shown(ranks))
    added = T.StructType([T.StructField(ids, IDS, False), T.StructField(data, T.BinaryType(), False)])

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        encoded, decoded = _encoder(model.value, pattern), _decoder(table.value)
        for batch in batches:
            made = encoded(batch.column(text))
            yield batch, [made, decoded(made)]

    return adding(df, added, columns)


def decoded_text(data: str = "decoded"):
    """The decoded bytes as a string; bytes that are not UTF-8 become U+FFFD."""
    return F.make_valid_utf8(F.col(data).cast("string"))
