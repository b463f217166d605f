"""What filters remove alone and together, with word counts from a sparse document-term matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, join_small, stage

SHARD_BYTES = 2 << 20       # text whose rows make one shard of the matrix
ROW_BYTES = 128             # what a row counts besides its text
CHUNK_BYTES = 1 << 20       # text whose words are split and counted in one go
VOCABULARY_BYTES = 8 << 20  # words of shards that are put together before they are written
VOCABULARY_SHARDS = 16      # shards after which their words are written in any case
# Row groups of staged shards are what a task holds to write or read; a few rows may fill one.
BLOCKS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 4, "parquet.page.size.row.check.max": 1000,
          "compression": "zstd"}
MATRIX = ["rows", "indptr", "terms", "counts"]


def number_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def term_shards(frame: DataFrame, text: str, shard_bytes: int = SHARD_BYTES,
                number: Callable[[bytes], int] = number_of) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of ``frame`` in compressed sparse rows, and its dictionary.

    The dictionary (word binary, term long) has one row per distinct word of the whole table.
    A shard holds the rows of about ``shard_bytes`` of text, a row counting ``ROW_BYTES`` more:
    ``rows`` (an array of all columns but ``text``), and the little-endian buffers ``indptr`` (int64), ``terms`` (int64, numbers
    of the dictionary) and ``counts`` (int32).  Words are maximal runs without white space
    (20, 09-0D), told by case.

    Texts are split in chunks of ``CHUNK_BYTES`` and counted by sorting pairs of row and word,
    chunk by chunk.  A word's term is a 63-bit hash, so shards are written with their final
    terms.  Beside them lie the words, a row each; those of several shards are put together
    first, so a frequent word reaches the dictionary a few times per file and not once per
    document.  The dictionary shows which words share a hash.  Of those, some v^2 / 2^64 of v
    words, all but the smallest get terms below zero, and the shards are then made again with
    these, so terms and words are one to one.

    Null and empty texts are rows without entries; a single text above ``shard_bytes`` is a
    shard of its own.  An empty table gives empty results.  What a task holds does not depend
    on how much lies in a file: texts come to Python in batches of about a chunk, shards one by
    one, and no row is larger than a shard nor a row group than about 16 MB.
    """
    byte_batches(frame.sparkSession, CHUNK_BYTES)
    others = [c for c in frame.columns if c != text]
    slim = frame.select(F.struct(*[frame[f"`{c}`"] for c in others]).alias("row"), frame[f"`{text}`"].alias("_text"))
    kind = slim.schema["row"].dataType.simpleString()

    def encode(number: Callable[[bytes], int], label: str, words: bool = True) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh: list[pa.Array] = []
            for shard in _shards(batches, shard_bytes):
                packed = shard.packed(number)
                yield pa.RecordBatch.from_arrays([*map(packed.column, MATRIX), pa.nulls(1, pa.binary())], [*MATRIX, "word"])
                if words:
                    fresh.append(packed.column("words").flatten())
                    if len(fresh) == VOCABULARY_SHARDS or sum(v.nbytes for v in fresh) > VOCABULARY_BYTES:
                        yield from _word_rows(fresh, packed.schema)
                        fresh = []
            if fresh:
                yield from _word_rows(fresh, packed.schema)
        return stage(slim.mapInArrow(_tidy(run), f"rows array<{kind}>, indptr binary, terms binary, counts binary, word binary"),
                     label, **BLOCKS)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(_numbers(batch.column("word"), number))], ["word", "term"])

    local = encode(number, "shards")
    known = stage(local.filter("word is not null").select("word").distinct()
                  .mapInArrow(_tidy(numbered), "word binary, term long"), "dictionary")
    twice = stage(known.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("term"), "clashing")
    clashing = sorted((r.term, bytes(r.word)) for r in join_small(known, twice, ["term"]).collect())
    second = [word for k, (term, word) in enumerate(clashing) if k and clashing[k - 1][0] == term]
    instead = {word: -1 - k for k, word in enumerate(second)}
    if instead:
        local = encode(lambda word: instead[word] if word in instead else number(word), "shards-again", words=False)
        place = F.create_map(*[F.lit(x) for pair in instead.items() for x in pair])
        known = known.withColumn("term", F.coalesce(F.try_element_at(place, F.col("word")), F.col("term")))
    return local.filter("indptr is not null").select(*MATRIX), known


def _tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
          ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, after which its idle worker gives what Arrow has freed back to the system."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
    return run


def _copied(rows: pa.Array, begin: int, end: int) -> pa.Array:
    """Some rows without the batch they came in, whose texts would stay in memory with them."""
    return rows.take(pa.array(range(begin, end), pa.int32()))


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[_Shard]:
    """Rows in shards of about ``shard_bytes`` of text, each added in chunks."""
    shard, size = _Shard(), 0
    for batch in batches:
        begun, waiting = 0, 0
        for i, length in enumerate(pc.add(pc.fill_null(pc.binary_length(batch.column("_text")), 0), ROW_BYTES).to_pylist()):
            if size and size + length > shard_bytes:
                shard.add(batch, begun, i)
                yield shard
                begun, waiting, shard, size = i, 0, _Shard(), 0
            elif waiting and waiting + length > CHUNK_BYTES:
                shard.add(batch, begun, i)
                begun, waiting = i, 0
            size, waiting = size + length, waiting + length
        shard.add(batch, begun, batch.num_rows)
    if sum(map(len, shard.rows)):
        yield shard


def _word_rows(vocabularies: list[pa.Array], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The distinct words of some shards, a row each beside the columns of a shard."""
    words = pc.unique(pa.chunked_array(vocabularies))
    for at in range(0, len(words), 10_000):
        some = words.slice(at, 10_000)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), schema.field(c).type) for c in MATRIX), some], [*MATRIX, "word"])


def _numbers(words: pa.Array, number: Callable[[bytes], int]) -> np.ndarray:
    return np.fromiter((number(w) for at in range(0, len(words), 10_000)
                        for w in words.slice(at, 10_000).to_numpy(zero_copy_only=False)), np.int64, len(words))


class _Shard:
    """Rows under way, with their texts already split into words."""

    def __init__(self) -> None:
        self.rows, self.places, self.words = [], [], []

    def add(self, batch: pa.RecordBatch, begin: int, end: int) -> None:
        self.rows.append(_copied(batch.column("row"), begin, end))
        split = pc.ascii_split_whitespace(pc.fill_null(batch.column("_text").slice(begin, end - begin), ""))
        words = split.flatten()    # split at 20 and 09-0D, nothing else
        place = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        some = pc.greater(pc.binary_length(words), 0)    # white space at an end leaves an empty word
        self.places.append(place[some.to_numpy(zero_copy_only=False)].astype(np.int32))
        self.words.append(words.filter(some))

    def packed(self, number: Callable[[bytes], int]) -> pa.RecordBatch:
        # As one array: of several, Arrow leaves out those without words.
        rows, coded = pa.concat_arrays(self.rows), pa.concat_arrays(self.words).dictionary_encode()
        vocabulary, numbers, upto = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), 0
        kinds = max(len(vocabulary), 1)
        indptr, terms, counts = [np.zeros(1, np.int64)], [], []
        for some, place in zip(self.rows, self.places):
            # A key tells row and word, so equal keys are a word's occurrences in a row.
            keys = np.sort(place * np.int64(kinds) + numbers[upto:upto + len(place)])
            upto += len(place)
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            place, term = np.divmod(keys[first], kinds)
            terms.append(term.astype(np.int32))
            counts.append(np.diff(first, append=len(keys)).astype(np.int32))
            indptr.append(indptr[-1][-1] + np.cumsum(np.bincount(place, minlength=len(some)), dtype=np.int64))
        del coded, numbers
        self.places, self.words = [], []
        indptr, terms, counts = map(np.concatenate, (indptr, terms, counts))
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
             pa.ListArray.from_arrays(pa.array([0, len(vocabulary)], pa.int32()), vocabulary),
             *[pa.array([b.tobytes()], pa.binary()) for b in (indptr, _numbers(vocabulary, number)[terms], counts)]],
            ["rows", "words", "indptr", "terms", "counts"])


def row_totals(shards: DataFrame) -> DataFrame:
    """(row, n_words, n_distinct) for every row of the shards: row sums and numbers of terms."""
    kind = shards.schema["rows"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                indptr = np.frombuffer(batch.column("indptr")[i].as_py(), np.int64)
                counts = np.frombuffer(batch.column("counts")[i].as_py(), np.int32)
                upto = np.append(0, np.cumsum(counts, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rows").slice(i, 1).flatten(), pa.array(np.diff(upto[indptr])),
                     pa.array(np.diff(indptr))], ["row", "n_words", "n_distinct"])
    return shards.select("rows", "indptr", "counts").mapInArrow(
        _tidy(run), f"row {kind}, n_words long, n_distinct long")


def repeats(frame: DataFrame, id_: str, key: str) -> DataFrame:
    """``frame`` with ``repeated``: some row of a smaller id has an equal ``key``.

    Rows without an id come after all others and are never the smaller one; rows that share
    an id aren't repeats of each other.  Only keys that several ids have are joined.
    """
    alike = stage(frame.groupBy(key).agg(F.min(id_).alias("_first"), F.count(F.lit(1)).alias("_n"))
                  .filter("_n > 1 and _first is not null").select(key, "_first"), "alike")
    joined = join_small(frame, alike, [key], "left")
    later = F.col(id_).isNull() | (F.col(id_) > F.col("_first"))
    return joined.withColumn("repeated", F.col("_first").isNotNull() & later).drop("_first")


def audit(frame: DataFrame, part: str, failing: Mapping[str, Column], outcomes: Mapping[str, Column]) -> DataFrame:
    """How many rows of each part every filter removes, in every order of the filters.

    ``failing`` maps one letter per filter to its condition of failure, ``outcomes`` names the
    columns that count rows a step removes to conditions on the row (``good_lost``: quality is
    1).  A null condition counts as false.  Rows are first summed to one per part and set of
    failed filters, at most 2^filters a part; those meet each order and step.  Returns part,
    filter_order, step, kept, removed, redundant, unique_fails, the outcomes and shapley, with
    zeros, for every part that has rows; nothing for an empty table.
    """
    letters = list(failing)
    bits = {letter: 1 << k for k, letter in enumerate(letters)}
    whole = _factorial(len(letters))
    mask = sum((F.when(condition, F.lit(bits[k])).otherwise(F.lit(0)) for k, condition in failing.items()), F.lit(0))
    sums = frame.groupBy(part, mask.alias("_mask")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.when(condition, F.lit(1))).alias(f"_{name}") for name, condition in outcomes.items()])
    steps = [(order, step, bits[order[step - 1]], sum(bits[k] for k in order[:step - 1]))
             for order in orders(letters) for step in range(1, len(letters) + 1)]
    each = F.from_json(F.lit(_json(steps)), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    fails = F.col("_mask").bitwiseAND(F.col("own")) != 0
    reached = F.col("_mask").bitwiseAND(F.col("before")) == 0

    def total(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(F.lit(0))).cast("long")
    n = F.col("_n")
    met = sums.withColumn("_each", F.explode(each)).select("*", "_each.*")
    return met.groupBy(part, "filter_order", "step").agg(
        total(reached & ~fails, n).alias("kept"), total(reached & fails, n).alias("removed"),
        total(~reached & fails, n).alias("redundant"), total(F.col("_mask") == F.col("own"), n).alias("unique_fails"),
        *[total(reached & fails, F.col(f"_{name}")).alias(name) for name in outcomes],
        # In an order drawn at random each filter a row fails is equally likely to remove it.
        total(fails, n * F.floor(F.lit(whole) / F.greatest(F.bit_count("_mask"), F.lit(1)))).alias("shapley"))


def orders(letters: Sequence[str]) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def _factorial(n: int) -> int:
    return 1 if n < 2 else n * _factorial(n - 1)


def _json(steps: Sequence[tuple[str, int, int, int]]) -> str:
    return "[" + ",".join('{"filter_order":"%s","step":%d,"own":%d,"before":%d}' % s for s in steps) + "]"
