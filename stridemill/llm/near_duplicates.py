"""MinHash near-duplicates with sequential Bayesian verification."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, stage, text_batches
from .components import components
from .shingles import common, mix64, shingle_set

HASHES, ROWS, BANDS, STEP = 256, 5, 30, 32   # the bands take the first 150 hashes
BLOCK = 1024             # members of a bucket that meet in one task
SET_BYTES = 32 << 20     # and their shingle sets
PAIRS_AT_ONCE = 50_000
_RANDOM = np.random.default_rng(7919)
_FACTOR = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Low bytes of a set's smallest values under 256 hash functions."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 512):
            values = _FACTOR[:, None] * hashes[None, at:at + 512] + _SHIFT[:, None]
            low = np.minimum(low, values.min(axis=1))
    return (low >> np.uint64(40)).astype(np.uint8)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each signature and band."""
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), BANDS)).copy()
        for k in range(ROWS):
            key = (key << np.uint64(8)) | signatures[:, k:ROWS * BANDS:ROWS]
    return mix64(key).view(np.int64)


def least_matches(similarity: float, miss: float) -> np.ndarray:
    """Matches a pair needs after every further batch of hashes to stay a candidate.

    With a uniform prior and m of n hashes alike the similarity s has a Beta(m + 1, n - m + 1)
    posterior, and P(s >= t) is the chance of at most m successes in n + 1 trials of chance t.
    A pair goes as soon as that falls below ``miss``.
    """
    def posterior(m: int, n: int) -> float:
        return sum(comb(n + 1, j) * similarity ** j * (1 - similarity) ** (n + 1 - j) for j in range(m + 1))
    return np.array([next(m for m in range(n + 1) if posterior(m, n) >= miss)
                     for n in range(STEP, HASHES + 1, STEP)])


def survivors(one: np.ndarray, other: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places of the pairs of signatures (rows of bytes) that outlast every batch."""
    alive, matches = np.arange(len(one)), np.zeros(len(one), np.int64)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (one[alive, part] == other[alive, part]).sum(axis=1)
        stay = matches >= need
        alive, matches = alive[stay], matches[stay]
    return alive


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def signed(frame: DataFrame, id_: str, text: str, width: int) -> DataFrame:
    """(id, n, digest, sig): size and digest of the shingle set, and its signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t, width) if t else np.zeros(0, np.uint64)
                        for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column("_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ], ["id", "n", "digest", "sig"])

    slim = frame.select(frame[f"`{id_}`"].alias("_id"), frame[f"`{text}`"].alias("_text"))
    return slim.mapInArrow(run, f"id {slim.schema['_id'].dataType.simpleString()}, n long, digest binary, "
                                "sig binary")


def banded(classes: DataFrame) -> DataFrame:
    """(rep, band, key) for every class and band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(_bytes(batch.column("sig"), HASHES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS)),
                 pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))), pa.array(keys.ravel())],
                ["rep", "band", "key"])
    return classes.select("rep", "sig").mapInArrow(run, "rep long, band int, key long")


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sets(reps: DataFrame, members: DataFrame, frame: DataFrame, id_: str, text: str, width: int) -> DataFrame:
    """(rep, members): the full shingle sets of some classes, made again from their texts."""
    wanted = stage(reps.join(members.select("rep", F.col("id").alias("_id"), "digest"), "rep"), "wanted")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t, width) if t else np.zeros(0, np.uint64)
                        for t in part.column("_text").to_pylist()]
                mine = [i for i, (s, d) in enumerate(zip(sets, part.column("digest").to_pylist()))
                        if digest(s) == d]
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep").take(pa.array(mine, pa.int64())),
                     pa.array([sets[i].tobytes() for i in mine], pa.binary())], ["rep", "members"])

    texts = frame.select(frame[f"`{id_}`"].alias("_id"), frame[f"`{text}`"].alias("_text"))
    return stage(join_small(texts, wanted, ["_id"], limit=500_000).mapInArrow(build, "rep long, members binary"),
                 "sets")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = common(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _exact(pairs: DataFrame, members: DataFrame, frame: DataFrame, id_: str, text: str, width: int,
           percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are alike enough.  Only the sets in question travel."""
    sets = _sets(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), members, frame, id_, text, width)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (map(lambda x: np.frombuffer(x, np.uint64), batch.column(c).to_pylist()) for c in "xy")
            good = [i for i, (x, y) in enumerate(zip(one, other)) if _alike(x, y, percent)]
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    def side(node: str, name: str) -> DataFrame:
        return sets.select(F.col("rep").alias(node), F.col("members").alias(name))
    return (pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b")
            .select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"))


def near_duplicates(frame: DataFrame, id_: str, text: str, width: int = 5, percent: int = 80,
                    miss: float = 2e-4) -> DataFrame:
    """Group rows whose word shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns one row per row of ``frame``: ``id``, ``n`` (set size) and ``component``, the
    smallest id reachable over links, itself included.

    1. Rows with equal sets are one class; only classes go on.
    2. Signatures are banded.  Every class meets, in each of its buckets, the member that
       shares most buckets with others: in a group of near copies that is the text closest to
       all.  So a bucket gives as many pairs as it has members.
    3. Pairs are compared batch after batch of hashes and dropped once the posterior chance of
       similarity falls below ``miss``; what is left is verified on the full sets.
    4. Where the components leave a bucket in parts, its members meet in blocks, inside which
       only pairs of different components are compared, each in the first band it shares.
       First every member's likeliest pair is verified.  Then those that still have a candidate
       meet with their sets: candidates are verified on the spot, the likeliest first, unless
       links found before join the two already, so what leaves a task are spanning links.

    30 bands of 5 rows miss a pair of similarity 0.8 with chance 7e-6.  Null and empty texts,
    and texts without words, have the empty set and are linked with nothing.  Rows without
    an id aren't linked and have no component.  Rows that share an id are one node.  An empty
    table gives an empty result.
    """
    text_batches(frame.sparkSession)
    least = least_matches(percent / 100, miss)
    rows = stage(signed(frame, id_, text, width), "signed")
    # A class is named by a number, since rows of equal id may have different sets.
    classes = stage(rows.filter("digest is not null and id is not null").groupBy("digest")
                    .agg(F.min("id").alias("id"), F.min("sig").alias("sig"))
                    .withColumn("rep", F.monotonically_increasing_id()), "classes")
    bands = stage(banded(classes), "bands")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    buckets = stage(bands.join(shared, "key"), "buckets")
    sigs = classes.select("rep", "sig")

    degree = buckets.groupBy("rep").agg(F.sum("m").alias("degree"))
    # Tables that many rows join by one key are staged, so that Spark may split those joins.
    leaders = stage(buckets.join(degree, "rep").groupBy("key")
                    .agg(F.max_by("rep", F.col("degree") * 1024 + F.pmod("rep", F.lit(1024))).alias("lead")), "leaders")
    stars = (buckets.join(leaders, "key").filter("rep != lead")
             .select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct())

    def bayes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = survivors(_bytes(batch.column("x"), HASHES), _bytes(batch.column("y"), HASHES), least)
            yield batch.select(["a", "b"]).take(pa.array(stay))

    def with_sig(node: str, name: str) -> DataFrame:
        return sigs.select(F.col("rep").alias(node), F.col("sig").alias(name))
    likely = stage(stars.join(with_sig("a", "x"), "a").join(with_sig("b", "y"), "b")
                   .select("a", "b", "x", "y").mapInArrow(bayes, "a long, b long"), "likely")
    links = stage(_exact(likely, classes, frame, id_, text, width, percent), "links")

    def parted(links: DataFrame) -> DataFrame:
        """(key, band, m, rep, root) of the buckets that ``links`` leave in parts."""
        roots = components(links)
        placed = buckets.filter("m > 2").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "root", F.coalesce("root", "rep"))
        apart = stage(placed.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"))
                      .filter("_low < _high").select("key"), "parted")
        return stage(placed.join(apart, "key").select("key", "band", "m", "rep", "root"), "parts")

    def cells(members: DataFrame, blocks: Column, *carry: str) -> DataFrame:
        """Rows of each pair of blocks of a bucket, together and in order."""
        mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
        return (members.withColumn("_mine", mine).withColumn("_with", F.explode(F.sequence(F.lit(0), blocks - 1)))
                .select("key", "band", F.least("_mine", "_with").alias("lo"), F.greatest("_mine", "_with").alias("hi"),
                        F.col("_mine").alias("mine"), "rep", "root", "sig", *carry)
                .repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep"))
    by_count = F.ceil(F.col("m") / BLOCK).cast("int")

    # First the likeliest pair of every member is verified, which joins most of what belongs together.
    first = stage(cells(parted(links).join(sigs, "rep"), by_count)
                  .mapInArrow(lambda batches: _in_cells(batches, least, _likeliest), "a long, b long"), "likeliest")
    if not first.isEmpty():
        links = stage(links.union(_exact(first, classes, frame, id_, text, width, percent)), "links")
        left = parted(links)
        # Then only members that still have a candidate meet, with their sets.
        flagged = stage(cells(left.join(sigs, "rep"), by_count)
                        .mapInArrow(lambda batches: _in_cells(batches, least, _flagged), "key long, rep long").distinct(), "flagged")
        sets = _sets(flagged.select("rep").distinct(), classes, frame, id_, text, width)
        sized = flagged.join(sets.select("rep", F.octet_length("members").alias("_size")), "rep")
        blocks = stage(sized.groupBy("key").agg(F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("_size") / SET_BYTES)).cast("int").alias("blocks")), "blocks")
        again = left.join(flagged, ["key", "rep"]).join(blocks, "key").join(sigs, "rep").join(sets, "rep")
        spanning = cells(again, F.col("blocks"), "members").mapInArrow(
            lambda batches: _in_cells(batches, least, lambda *cell: _spanning(*cell, percent)), "a long, b long")
        links = links.union(stage(spanning, "links"))

    # From classes to ids: a component is called by the smallest id in it.
    many = rows.filter("digest is not null").groupBy("id").agg(F.min("digest").alias("_a"), F.max("digest").alias("_b"))
    same = (rows.select("id", "digest").distinct().join(many.filter("_a < _b").select("id"), "id")
            .join(classes.select("digest", "rep"), "digest").select("id", "rep"))
    same = (same.join(same.groupBy("id").agg(F.min("rep").alias("a")), "id").filter("rep != a")
            .select("a", F.col("rep").alias("b")))
    named = components(links.union(same))
    of_class = classes.select("digest", F.col("id").alias("_first"), "rep").join(
        named.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least_id = stage(of_class.groupBy("root").agg(F.min("_first").alias("_component")), "components")
    of_class = stage(of_class.join(least_id, "root").select("digest", "_component"), "named")
    return (rows.select("id", "n", "digest").join(of_class, "digest", "left")
            .select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("_component", "id")).alias("component")))


Found = Callable[[pa.Table, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]]


def _in_cells(batches: Iterator[pa.RecordBatch], least: np.ndarray, found: Found) -> Iterator[pa.RecordBatch]:
    """What ``found`` makes of the likely pairs inside each (key, lo, hi), rows sorted by it."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        cut = _last_cell(table)
        held = table.slice(cut)
        yield from _of_table(table.slice(0, cut), least, found)
    if held is not None:
        yield from _of_table(held, least, found)


def _cell_numbers(table: pa.Table) -> np.ndarray:
    columns = [table.column(c).to_numpy() for c in ("key", "lo", "hi")]
    return np.cumsum(np.append(False, np.logical_or.reduce([np.diff(c) != 0 for c in columns])))


def _last_cell(table: pa.Table) -> int:
    if not table.num_rows:
        return 0
    number = _cell_numbers(table)
    return int(np.searchsorted(number, number[-1]))


def _of_table(table: pa.Table, least: np.ndarray, found: Found) -> Iterator[pa.RecordBatch]:
    if table.num_rows > 1:
        sig = _bytes(table.column("sig"), HASHES)
        yield from found(table, sig, _likely(table, sig, least))


def _likely(table: pa.Table, sig: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell and different components that outlast the bounds, in portions."""
    number = _cell_numbers(table)
    root, mine = (table.column(c).to_numpy() for c in ("root", "mine"))
    crossing = table.column("lo").to_numpy() != table.column("hi").to_numpy()
    band = table.column("band").to_numpy()
    after = np.searchsorted(number, number, side="right") - np.arange(len(number)) - 1
    ends = np.cumsum(after)
    at = 0
    while at < len(number):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        count = after[at:upto]
        i = np.repeat(np.arange(at, upto), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        go = (root[i] != root[j]) & (~crossing[i] | (mine[i] != mine[j]))
        i, j = i[go], j[go]
        stay = survivors(sig[i], sig[j], least)
        i, j = i[stay], j[stay]
        # A pair counts in the first band it shares.
        alike = (sig[i, :ROWS * BANDS] == sig[j, :ROWS * BANDS]).reshape(-1, BANDS, ROWS).all(axis=2)
        here = alike.argmax(axis=1) == band[i]
        yield i[here], j[here]
        at = upto


def _pairs(table: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    one, other = table.column("rep").to_numpy()[i], table.column("rep").to_numpy()[j]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], ["a", "b"])


def _likeliest(table: pa.Table, sig: np.ndarray, likely: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Of every member the pair with most matches among those after it."""
    for i, j in likely:
        order = np.lexsort((-(sig[i] == sig[j]).sum(axis=1), i))
        i, j = i[order], j[order]
        top = np.append(True, np.diff(i) != 0)[:len(i)]
        yield _pairs(table, i[top], j[top])


def _flagged(table: pa.Table, sig: np.ndarray, likely: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The members of a bucket that have any likely pair."""
    met = np.zeros(table.num_rows, bool)
    for i, j in likely:
        met[i] = met[j] = True
    yield pa.RecordBatch.from_arrays([pa.array(table.column(c).to_numpy()[met]) for c in ("key", "rep")], ["key", "rep"])


def _spanning(table: pa.Table, sig: np.ndarray, likely: Iterator[tuple[np.ndarray, np.ndarray]],
              percent: int) -> Iterator[pa.RecordBatch]:
    """Verified pairs, the likeliest first, each of which joins two components not joined here yet.

    So a cell gives fewer links than it has members, however many pairs are near the threshold.
    """
    sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
    root = table.column("root").to_numpy()
    up: dict[int, int] = {}

    def top(node: int) -> int:
        while node in up:
            up[node] = node = up.get(up[node], up[node])
        return node
    for i, j in likely:
        links = []
        for k in np.argsort(-(sig[i] == sig[j]).sum(axis=1), kind="stable").tolist():
            one, other = top(int(root[i[k]])), top(int(root[j[k]]))
            if one != other and _alike(sets[i[k]], sets[j[k]], percent):
                up[one] = other
                links.append(k)
        yield _pairs(table, i[links], j[links])
