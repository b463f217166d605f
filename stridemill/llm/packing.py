"""Best-fit packing of tokenized documents by linear grouping."""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from .common import spread_rank, text_batches

CACHE_WORDS = 150_000    # encodings a worker remembers before it starts anew
BATCH_ROWS = 1024
END = 0                  # id that closes a document
MARKS = r"([\x00-\x08\x0E-\x1F!-/:-@\[-`{-~\x7F]+)"    # ASCII but letters, digits and blanks


class WordEncoder:
    """Ids of whole texts from the tokenizers library, each distinct word encoded once.

    Holds for byte-level tokenizers with word ends that lower-case and whose pre-tokens span neither a blank nor, outside
    of contractions and special tokens, an edge between ASCII marks and letters or digits.
    Texts with an apostrophe, a special token's opening, unnormalized letters or marks beyond
    ASCII are cut at blanks only.  Words met before come from ragged arrays; new ones go
    through the library in rows, kept apart by ``apart``, a special token of it.
    """

    def __init__(self, path: str, apart: str = "<|startoftext|>"):
        self.library = Tokenizer.from_file(path)
        self.apart, self.apart_id = apart, self.library.token_to_id(apart)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        end = self.library.model.end_of_word_suffix
        self.closes = np.array([self.library.id_to_token(i).endswith(end) for i in range(self.library.get_vocab_size())])
        self.reset()

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @staticmethod
    def splits(text: str) -> bool:
        # Letters are looked at as the library lower-cases them: one, U+0130, becomes a letter and a mark.
        return not ("'" in text or "<|" in text) and unicodedata.is_normalized("NFC", text) and (
            text.isascii() or "".join(c for c in set(text) if c > "\x7f").lower().isalnum())

    def learn(self, words: list[str]) -> None:
        # Lower-case letters alone are one pre-token, whose last symbol carries the word's end.
        # The library composes letters (NFC) first, so only composed words may go without its normalizer.
        plain, mixed, odd = [], [], []
        for word in words:
            (plain if word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)
             else odd if "<|" in word else mixed).append(word)
        flat = self._ids(self.letters, plain, " ")
        ends = np.flatnonzero(self.closes[flat])
        ids, at = [flat], [ends + 1]
        flat = self._ids(self.library, mixed, self.apart)
        keep = flat != self.apart_id
        ids.append(flat[keep])
        at.append(at[0][-1:].sum() + np.cumsum(keep)[~keep])
        for word in odd:
            ids.append(np.array(self.library.encode(word, add_special_tokens=False).ids, np.uint32))
            at.append(np.array([sum(map(len, ids))]))
        first = len(self.code)
        self.code.update(zip([*plain, *mixed, *odd], range(first, first + len(words))))
        self.at = np.concatenate([self.at, self.at[-1] + np.concatenate(at)])
        self.ids = np.concatenate([self.ids, *ids])

    @staticmethod
    def _ids(tool: Tokenizer, words: list[str], apart: str) -> np.ndarray:
        """Ids of words, each followed by ``apart``, some hundred in a row."""
        rows = [apart.join([*words[i:i + 200], ""]) for i in range(0, len(words), 200)]
        found = [np.array(e.ids, np.uint32) for e in tool.encode_batch_fast(rows, add_special_tokens=False)]
        return np.concatenate([*found, np.zeros(0, np.uint32)])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = texts.cast(pa.string())
        apart = pa.array([self.splits(t) for t in texts.to_pylist()], pa.bool_())
        spaced = pc.replace_substring_regex(pc.ascii_lower(texts), MARKS, r" \1 ")
        words = pc.ascii_split_whitespace(pc.if_else(apart, spaced, texts))
        found = words.flatten().dictionary_encode()
        distinct = found.dictionary.to_pylist()
        if len(self.code) > CACHE_WORDS:
            self.reset()
        codes = list(map(self.code.get, distinct))
        new = [i for i, code in enumerate(codes) if code is None]
        self.learn([distinct[i] for i in new])
        for i in new:
            codes[i] = self.code[distinct[i]]
        codes = np.array(codes, np.int64)[found.indices.to_numpy()]
        starts = self.at[codes]
        sizes = self.at[codes + 1] - starts
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(sizes.sum()) + np.repeat(starts - ends + sizes, sizes)]
        cuts = np.append(0, ends)[words.offsets.to_numpy() - words.offsets[0].as_py()]
        for start, end in zip(cuts[:-1], cuts[1:]):
            yield ids[start:end]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    # Spark runs one task per core; threads of the library would only add memory.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def pieces(frame: DataFrame, text: str, tokenizer: str, capacity: int = 2048,
           with_ids: bool = False) -> DataFrame:
    """Cut every document's ids, closed by id 0, into pieces of at most ``capacity``.

    Returns the other columns of ``frame`` as ``row``, and ``piece`` from 0, ``start``,
    ``length``, ``ids_crc32`` and, if asked for, ``ids``.  Null and empty texts are one piece
    of one id.  Only documents above ``capacity`` are cut.  ``tokenizer`` is a path that
    executors can open.
    """
    text_batches(frame.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                row, piece, start, ids = [], [], [], []
                for i, found in enumerate(tool.encode(part.column("_text"))):
                    found = np.append(found, np.uint32(END)).astype("<u4")
                    for k, begin in enumerate(range(0, len(found), capacity)):
                        row.append(i), piece.append(k), start.append(begin)
                        ids.append(found[begin:begin + capacity])
                arrays = [part.column(c).take(pa.array(row, pa.int64())) for c in names]
                arrays += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array([len(x) for x in ids], pa.int64()),
                           pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    kept = [c for c in frame.columns if c != text]
    names = [f"c{i}" for i in range(len(kept))]
    slim = frame.select(*[frame[f"`{c}`"].alias(n) for c, n in zip(kept, names)],
                        F.coalesce(frame[f"`{text}`"].cast("string"), F.lit("")).alias("_text"))
    schema = T.StructType([f for f in slim.schema if f.name != "_text"]
                          + [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                             T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
                          + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    return slim.mapInArrow(run, schema).select(
        F.struct(*[F.col(n).alias(c) for c, n in zip(kept, names)] or [F.lit(None).alias("_")]).alias("row"),
        "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)


def configurations(sizes: Sequence[int], demand: Sequence[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole multiplicities of sequence patterns over a few sizes.

    Solves the linear relaxation by column generation: the simplex basis starts with one
    pattern per size, an integer knapsack over the duals prices the next one, and the basic
    solution is rounded down.  What is not covered is left to the caller.
    """
    k, sizes = len(sizes), np.asarray(sizes)
    demand = np.asarray(demand, float)
    basis = np.diag((capacity // sizes).astype(float))
    amount = demand / np.diag(basis)
    for _ in range(60 * k):
        dual = np.linalg.solve(basis.T, np.ones(k))
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(sizes.min()), capacity + 1):
            fits = np.flatnonzero(sizes <= room)
            values = best[room - sizes[fits]] + dual[fits]
            at = int(values.argmax())
            if values[at] > max(best[room - 1], 0) + 1e-12:
                best[room], choice[room] = values[at], fits[at]
            else:
                best[room], choice[room] = best[room - 1], -2
        if best[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(k), capacity
        while room > 0 and choice[room] != -1:
            if choice[room] == -2:
                room -= 1
            else:
                column[choice[room]] += 1
                room -= sizes[choice[room]]
        step = np.linalg.solve(basis, column)
        positive = np.flatnonzero(step > 1e-9)
        if not len(positive):
            break
        leave = positive[int(np.argmin(amount[positive] / step[positive]))]
        theta = amount[leave] / step[leave]
        amount = amount - theta * step
        amount[leave] = theta
        basis[:, leave] = column
    whole = [(basis[:, i].astype(int), int(amount[i] + 1e-7)) for i in range(k)]
    return [(pattern, times) for pattern, times in whole if times > 0]


class Layout:
    """Sequences with equal room, and where every run of equal lengths was put.

    ``runs`` has (length, first rank, count, first sequence, offset): the documents of that
    length ranked from there go one each into consecutive sequences, at that offset.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, dict(counts)
        self.ranks = dict.fromkeys(counts, 0)
        self.open: dict[int, list[tuple[int, int]]] = {}   # room -> (first sequence, count)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0

    def put(self, length: int, count: int, first: int, room: int) -> None:
        self.runs.append((length, self.ranks[length], count, first, self.capacity - room))
        self.ranks[length] += count
        self.left[length] -= count

    def new(self, count: int) -> int:
        first, self.sequences = self.sequences, self.sequences + count
        return first

    def keep(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.open.setdefault(room, []).append((first, count))

    def best_fit(self, length: int) -> None:
        """Put all that is left of a length where the room is least."""
        while self.left[length]:
            fitting = [room for room in self.open if room >= length]
            if not fitting:
                many = self.capacity // length
                count, per = (self.left[length] // many, many) if self.left[length] >= many else (1, self.left[length])
                first = self.new(count)
                for i in range(per):
                    self.put(length, count, first, self.capacity - i * length)
                self.keep(self.capacity - per * length, first, count)
                continue
            room = min(fitting)
            first, count = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
            used = min(count, self.left[length])
            self.put(length, used, first, room)
            self.keep(room - length, first, used)
            self.keep(room, first + used, count - used)


def layout(counts: dict[int, int], capacity: int = 2048, groups: int = 24, large: float = 1 / 3,
           by_fit: int = 1) -> Layout:
    """Pack a histogram of lengths, at most ``capacity`` of them, by linear grouping.

    Lengths above ``large`` times the capacity, longest first, form ``groups`` of equally many
    documents, each rounded up to its longest.  The configurations of those few sizes are
    optimised; each takes its group's actual documents, longest first, for all but its
    smallest ``by_fit`` places.  Those places, what rounding down left over and the small
    lengths follow, longest first, by best fit on actual lengths: that way the room rounding
    up had set aside is used too.
    """
    plan = Layout(counts, capacity)
    if counts.get(capacity):
        plan.put(capacity, counts[capacity], plan.new(counts[capacity]), capacity)
    lengths = [n for n in sorted(counts, reverse=True) if capacity * large < n < capacity]
    total = sum(counts[n] for n in lengths)
    if total:
        queues: list[list[list[int]]] = [[]]    # for each group: [length, count] from the longest
        share, room = -(-total // groups), -(-total // groups)
        for n in lengths:
            left = counts[n]
            if len(lengths) <= groups and queues[-1]:
                queues.append([])    # so few lengths need no rounding
            while left:
                if not room and len(lengths) > groups:
                    queues.append([])
                    room = share
                used = min(left, room) if len(lengths) > groups else left
                queues[-1].append([n, used])
                left, room = left - used, room - used
        merged: dict[int, list[list[int]]] = {}
        for queue in queues:
            merged.setdefault(queue[0][0], []).extend(queue)
        sizes = list(merged)
        demand = [sum(c for _, c in merged[s]) for s in sizes]
        for pattern, times in configurations(sizes, demand, capacity):
            parts = [(plan.new(times), times, capacity)]
            slots = [size for size, n in zip(sizes, pattern) for _ in range(n)]
            for size in slots[:max(1, len(slots) - by_fit)]:
                parts = list(_fill(plan, merged[size], parts))
            for first, count, gap in parts:
                plan.keep(gap, first, count)
    for n in sorted(counts, reverse=True):
        plan.best_fit(n)
    return plan


def _fill(plan: Layout, queue: list[list[int]], parts: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Give every sequence of ``parts`` the next document of a group."""
    for first, count, room in parts:
        while count and queue:
            length, there = queue[0]
            used = min(count, there)
            plan.put(length, used, first, room)
            yield first, used, room - length
            first, count, queue[0][1] = first + used, count - used, there - used
            if not queue[0][1]:
                queue.pop(0)
        if count:
            yield first, count, room


def pack(frame: DataFrame, key: Sequence[str], capacity: int = 2048, groups: int = 24, buckets: int = 256,
         seed: int = 41) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``.

    Only the histogram of lengths, one row for each of at most ``capacity`` lengths, comes to
    the driver; the layout it yields speaks of ranks, and every piece is ranked within its
    length in Spark, inside hash buckets of ``key`` (columns or expressions) so that a frequent
    length is no hot group.  The layout is sent to the tasks; its size depends on the capacity
    and not on the rows.  Pieces of equal key are interchangeable.  ``frame`` is used twice:
    stage it if it is costly.  An empty table gives an empty result.
    """
    spark = frame.sparkSession
    counts = {int(r[0]): int(r[1]) for r in frame.groupBy("length").count().collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    runs = sorted(layout(counts, capacity, groups).runs)
    shared = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))
    shift = 1 << 44

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = table[np.searchsorted(starts, length * shift + rank, side="right") - 1]
            found = [pa.array(at[:, 3] + rank - at[:, 1]), pa.array(at[:, 4])]
            kept = [batch.column(c) for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*kept, *found], schema.names)

    ranked = spread_rank(
        frame.withColumn("_hash", F.xxhash64(F.lit(seed), *map(F.col, key)))
        .withColumn("_bucket", F.pmod("_hash", F.lit(buckets))),
        ["length"], "_bucket", ["_hash"], "_rank", "_of").select(*frame.columns, "_rank")
    schema = T.StructType([*frame.schema, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)
