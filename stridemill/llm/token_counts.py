"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

NONE = np.int64(1) << 40          # rank of a pair that never merges
CACHE_WORDS = 300_000             # counts a worker remembers before it starts anew
BATCH_ROWS = 256
WORD = re.compile("▁*[^▁]+|▁+")


class PairTable:
    """Pairs of symbols to (rank, merged symbol): an open-addressing table in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.int64) << 32) | right
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.merged = np.full(1 << self.bits, NONE, np.int64), np.zeros(1 << self.bits, np.int32)
        self.probes, waiting, slot = 0, np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = np.zeros(len(slot), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.rank[slot[put]] = keys[waiting[put]], rank[waiting[put]]
            self.merged[slot[put]] = merged[waiting[put]]
            waiting, slot = waiting[~put], (slot[~put] + 1) & (len(self.keys) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            open_ = open_[(found != keys[open_]) & (found != -1)]
        hit = self.keys[slot] == keys
        return np.where(hit, self.rank[slot], NONE), self.merged[slot]


def merge_lengths(symbols: np.ndarray, starts: np.ndarray, pairs: PairTable, width: np.ndarray) -> np.ndarray:
    """Tokens left of each sequence when no pair of its symbols can merge any more.

    ``symbols`` holds the sequences one after another, ``starts`` where each begins;
    ``width[s]`` is what a surviving symbol s counts.  Every round finds each sequence's
    lowest rank and merges its occurrences from the left, as a queue ordered by (rank, place)
    would: an occurrence that opens a pair of the same or a lower rank is the last one its
    sequence merges in that round.  Finished sequences leave the arrays.
    """
    n = len(starts)
    totals = np.zeros(n, np.int64)
    if not len(symbols):
        return totals
    symbols = symbols.astype(np.int32)
    owner = np.repeat(np.arange(n), np.diff(np.append(starts, len(symbols))))

    def ranks_at(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = places + 1 >= len(symbols)
        nxt = np.where(ends, places, places + 1)
        rank, merged = pairs.find(symbols[places], symbols[nxt])
        return np.where(ends | (owner[nxt] != owner[places]), NONE, rank), merged

    rank, merged = ranks_at(np.arange(len(symbols)))
    while True:
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        low = np.minimum.reduceat(rank, heads)
        sizes = np.diff(np.append(heads, len(symbols)))
        low_of = np.repeat(low, sizes)
        active = low_of < NONE
        if not active.all():
            done = ~active
            totals += np.bincount(owner[done], weights=width[symbols[done]], minlength=n).astype(np.int64)
            symbols, owner, rank, merged, low_of = (x[active] for x in (symbols, owner, rank, merged, low_of))
            if not len(symbols):
                return totals
        at = np.flatnonzero(rank == low_of)
        # Occurrences that overlap (x x x): every second one of a run counts.
        run = np.cumsum(np.append(True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])))
        first = np.flatnonzero(np.append(True, np.diff(run) != 0))
        at = at[(np.arange(len(at)) - first[run - 1]) % 2 == 0]
        new = merged[at]
        # Pairs that an occurrence opens, as they stand when it merges.
        touches = np.append(False, (at[1:] == at[:-1] + 2) & (owner[at[1:]] == owner[at[:-1]]))
        before = np.maximum(at - 1, 0)
        left = np.where(touches, np.append(0, new[:-1]), symbols[before])
        has_left = touches | ((at > 0) & (owner[before] == owner[at]))
        after = np.minimum(at + 2, len(symbols) - 1)
        has_right = (at + 2 < len(symbols)) & (owner[after] == owner[at])
        left_rank, _ = pairs.find(left, new)
        right_rank, _ = pairs.find(new, symbols[after])
        opens = (has_left & (left_rank <= low_of[at])) | (has_right & (right_rank <= low_of[at]))
        if opens.any():
            # Within a sequence keep what comes up to the first such occurrence.
            earlier = np.cumsum(opens) - opens
            start = np.flatnonzero(np.append(True, owner[at[1:]] != owner[at[:-1]]))
            base = np.repeat(earlier[start], np.diff(np.append(start, len(at))))
            at, new = at[earlier == base], new[earlier == base]
        symbols[at] = new
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        symbols, owner, rank, merged = symbols[keep], owner[keep], rank[keep], merged[keep]
        at = moved[at]
        stale = np.unique(np.concatenate([at, at[at > 0] - 1]))
        rank[stale], merged[stale] = ranks_at(stale)


class PieceCounter:
    """Counts what the sentencepiece library's encode() gives for a byte-fallback BPE model."""

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i)
                                                or self.library.is_byte(i) or self.library.is_unused(i))]
        by_name = {names[i]: i for i in plain}
        if any(re.search("[^▁]▁", name) for name in by_name):
            raise ValueError("a piece spans a word boundary, so words can't be merged one by one")
        # Characters outside the vocabulary become one symbol each, worth their UTF-8 bytes.
        self.codes = {name: i for name, i in by_name.items() if len(name) == 1}
        self.unknown = [size + k for k in range(5)]
        self.width = np.concatenate([np.ones(size, np.int64), np.arange(5)])
        rows = [(by_name[name[:k]], by_name[name[k:]], i) for name, i in by_name.items()
                for k in range(1, len(name)) if name[:k] in by_name and name[k:] in by_name]
        left, right, merged = np.array(rows, np.int64).reshape(-1, 3).T
        # Equal scores share a rank; the place decides among them.
        scores = np.array([self.library.get_score(i) for i in range(size)])
        order = np.unique(-scores, return_inverse=True)[1]
        self.pairs = PairTable(left, right, order[merged].astype(np.int64), merged)
        self.table = np.full(0x110000, -1, np.int32)
        for char, i in self.codes.items():
            self.table[ord(char)] = i
        points = np.flatnonzero(self.table < 0)
        self.table[points] = size + 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        self.seen: dict[str, int] = {}

    def count_words(self, words: list[str]) -> np.ndarray:
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return merge_lengths(self.table[points], np.cumsum(lengths) - lengths, self.pairs, self.width)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; words met before are looked up, new ones merged together."""
        # A word is a run of marks and what follows it up to the next mark.
        split = [WORD.findall(self.library.normalize(t).replace(" ", "▁")) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in self.seen})
        if len(self.seen) + len(new) > CACHE_WORDS:
            self.seen = {}
            new = list({w for words in split for w in words})
        self.seen.update(zip(new, self.count_words(new).tolist()) if new else ())
        return np.array([sum(map(self.seen.__getitem__, words)) for words in split], np.int64)


@lru_cache(maxsize=2)
def counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def count_tokens(frame: DataFrame, text: str, model_file: str, limit: int = 4096) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row's ``row`` struct.

    Null counts as empty, an empty text has no tokens, whole texts are counted whatever
    their length, rows are independent, and an empty table gives an empty result.  The model
    file is a path that executors can open, installed with the tokenizers.
    """
    text_batches(frame.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(model_file)
        for batch in batches:
            texts = batch.column("_text")
            counts = [tool.count([t or "" for t in texts.slice(at, BATCH_ROWS).to_pylist()])
                      for at in range(0, len(texts), BATCH_ROWS)]
            kept = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]))], [*kept, "_n"])

    names = [f"c{i}" for i in range(len(frame.columns))]
    kept = [(c, n) for c, n in zip(frame.columns, names) if c != text]
    value = F.coalesce(frame[f"`{text}`"].cast("string"), F.lit(""))
    slim = frame.select(*[frame[f"`{c}`"].alias(n) for c, n in kept],
                        F.octet_length(value).cast("long").alias("_bytes"), value.alias("_text"))
    schema = slim.drop("_text").withColumn("_n", F.lit(0).cast("long")).schema
    return slim.mapInArrow(run, schema).select(
        F.struct(*[F.col(n).alias(c) for c, n in kept]).alias("row") if kept else F.lit(None).alias("row"),
        F.col("_bytes").alias("n_bytes"), F.col("_n").alias("n_tokens"),
        (F.col("_n") > limit).alias("over_limit"))
