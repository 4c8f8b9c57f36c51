"""Token counts of whole texts by rank-synchronous merging of arrays.

The file of a byte-level BPE of the ``tokenizers`` library is read on the driver and broadcast (a few MB, bounded by the
vocabulary). A task cuts its texts into pre-tokens and holds the distinct new ones of a batch as one ragged numpy array
of symbols, the bytes at first. In every round each pre-token looks up its pair of the lowest rank and merges all
places of that pair at once, from the left where they overlap; pre-tokens without a pair leave the array. Since no merge
has a lower rank than those that make its parts (checked when the file is read), this is the library's result, and
a pre-token takes at most one round for each rank, however long it is. The surviving symbols are counted; no ids are
built. Pre-tokens that a task has counted are remembered, at most ``REMEMBERED`` of them.

The pattern is matched by ``regex`` where every character lies in ``SAFE``, ranges in which it has the library's
classes; other texts are cut by the library, which knows another version of Unicode. Special tokens are found first,
leftmost and longest, and count one each; no begin or end is added, nothing is truncated or padded.

Defined cases: a null or empty text has no bytes and no tokens; a very long text or pre-token needs arrays of its own
length only; rows are independent, so ties and repeated rows need no rule; an empty table gives no rows. Extra columns
are passed through, and added columns replace columns of their names.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trustlake.llm.bpe import byte_characters
from trustlake.llm.common import adding, text_or_empty

#: Pre-tokens whose counts a task remembers; beyond it the memory starts anew, which changes the speed only.
REMEMBERED = 300_000

#: Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters that every version of Unicode in use puts into the same class of the pattern.
SAFE = ((0, 0x52F), (0x1E00, 0x206F), (0x20A0, 0xA4CF), (0xAC00, 0xD7A3), (0xFF00, 0xFFEF), (0x1F000, 0x1FAFF))

#: No merge joins this pair.
NONE = np.iinfo(np.int64).max


def byte_level(spec: str) -> dict:
    """The parsed file of a byte-level BPE; another kind of tokenizer raises ``ValueError``."""
    parsed = json.loads(spec)
    model, cut = parsed["model"], parsed["pre_tokenizer"] or {}
    plain = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    if (
        model.get("type", "BPE") != "BPE"
        or any(model.get(x) for x in plain)
        or parsed["normalizer"]
        or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True)
    ):
        raise ValueError("only byte-level BPE without normalizer, prefix space and dropout is supported")
    return parsed


class Merges:
    """Pairs of symbols with their ranks; the symbols of bytes, and the one that each rank makes."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_characters()], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left = np.fromiter((vocab[a] for a, _ in pairs), np.int64, len(pairs))
        right = np.fromiter((vocab[b] for _, b in pairs), np.int64, len(pairs))
        self.made = np.fromiter((vocab[a + b] for a, b in pairs), np.int64, len(pairs))
        self.width = max(vocab.values()) + 1
        made_at = np.full(self.width, -1)
        made_at[self.made] = np.arange(len(pairs))
        late = np.maximum(made_at[left], made_at[right]) >= np.arange(len(pairs))
        if late.any() or len(np.unique(self.made)) < len(pairs):
            raise ValueError("a merge comes before the merges that make its parts")
        keys = left * self.width + right
        self.ranks = np.argsort(keys)
        self.keys = keys[self.ranks]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where there is no merge."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        wanted = left * self.width + right
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, self.ranks[place], NONE)


def merged_counts(pieces: list[bytes], merges: Merges) -> np.ndarray:
    """How many symbols survive of each piece; pieces are not empty."""
    return _merged(pieces, merges, None)


def merged_ids(pieces: list[bytes], merges: Merges) -> list[bytes]:
    """The symbols that survive of each piece, as int32 in the machine's order."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    counts = _merged(pieces, merges, done)
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    for which, symbols in done:
        sizes = counts[which]
        out[np.arange(len(symbols)) + np.repeat(first[which] - (np.cumsum(sizes) - sizes), sizes)] = symbols
    data, ends = out.tobytes(), (4 * np.r_[first, len(out)]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def _merged(pieces: list[bytes], merges: Merges, done: list | None) -> np.ndarray:
    """Symbols of each piece; ``done`` takes (pieces, their symbols) as they are finished."""
    counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbols = merges.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    live, sizes = np.arange(len(pieces)), counts.copy()
    # rank[i] belongs to the symbols i and i + 1; the last symbol of a piece has no pair
    rank = np.full(len(symbols), NONE)
    rank[:-1] = merges.rank(symbols[:-1], symbols[1:])
    rank[np.cumsum(sizes) - 1] = NONE
    while len(live):
        best = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
        more = best < NONE
        if not more.all():
            counts[live[~more]] = sizes[~more]
            stay = np.repeat(more, sizes)
            if done is not None:
                done.append((live[~more], symbols[~stay]))
            symbols, rank = symbols[stay], rank[stay]
            live, sizes, best = live[more], sizes[more], best[more]
            if not len(live):
                break
        at = _apart(np.flatnonzero(rank == np.repeat(best, sizes)))
        last = np.cumsum(sizes) - 1
        sizes = sizes - np.diff(np.searchsorted(at, np.r_[0, last + 1]))
        symbols[at] = merges.made[rank[at]]
        gone = np.zeros(len(symbols), bool)
        gone[at + 1] = True
        symbols, rank = symbols[~gone], rank[~gone]
        at -= np.arange(len(at))  # where the merged symbols are now
        _look_up(at, symbols, rank, sizes, merges)
    return counts


def _apart(at: np.ndarray) -> np.ndarray:
    """Places of one pair without those that overlap an earlier one: every second of a run of neighbours."""
    run = np.r_[True, np.diff(at) > 1]
    if run.all():
        return at
    index = np.arange(len(at))
    return at[(index - np.maximum.accumulate(np.where(run, index, 0))) % 2 == 0]


def _look_up(at: np.ndarray, symbols: np.ndarray, rank: np.ndarray, sizes: np.ndarray, merges: Merges) -> None:
    """Ranks of the pairs on both sides of the merged symbols."""
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(sizes) - 1] = True
    rank[at] = NONE
    first = at[~last[at]]
    before = at[at > 0] - 1
    for i in (first, before[~last[before]]):
        rank[i] = merges.rank(symbols[i], symbols[i + 1])


def splitter(tokenizer) -> Callable[[str], list[str]]:
    """In a task: the pre-tokens of a text, as the byte-level ``tokenizer`` cuts it."""
    import regex

    pieces_of, strange = regex.compile(PATTERN).findall, regex.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SAFE) + "]").search
    cut = tokenizer.pre_tokenizer.pre_tokenize_str

    def split(text: str) -> list[str]:
        if text.isascii() or not strange(text):
            return pieces_of(text)
        return [text[a:b] for _, (a, b) in cut(text)]

    return split


def _special(added: list[dict]) -> Callable[[str], list[str]] | None:
    """In a task: the texts between the special tokens, which are as many less one; None without special tokens."""
    import regex

    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that take white space or whole words are not supported")
    longest = sorted((t["content"] for t in added), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, longest))).split if longest else None


class Counter:
    """In a task: token counts of texts."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        parsed = byte_level(spec)
        self.merges = Merges(parsed["model"])
        self.split = splitter(Tokenizer.from_str(spec))
        self.between = _special(parsed["added_tokens"])
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> np.ndarray:
        special = np.zeros(len(texts), np.int64)
        rows: list[list[str]] = []
        for i, t in enumerate(texts):
            between = self.between(t) if self.between else [t]
            special[i] = len(between) - 1
            rows.append(self.split(t) if len(between) == 1 else [*chain.from_iterable(map(self.split, between))])
        new = [*set(chain.from_iterable(rows)).difference(self.known)]
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = [*set(chain.from_iterable(rows))]
            self.known.update(zip(new, merged_counts([p.encode() for p in new], self.merges).tolist()))
        return special + np.fromiter((sum(map(self.known.__getitem__, row)) for row in rows), np.int64, len(rows))


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of its whole texts."""
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    byte_level(spec)
    shared = df.sparkSession.sparkContext.broadcast(spec)
    added = T.StructType(
        [T.StructField(n, kind, False) for n, kind in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()))]
    )

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        counter = Counter(shared.value)
        for batch in batches:
            texts = batch.column(text)
            n = counter.counts(text_or_empty(texts))
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield batch, [size, pa.array(n), pa.array(n > limit)]

    return adding(df, added, columns)
