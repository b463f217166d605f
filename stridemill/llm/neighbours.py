"""Approximate nearest neighbours over shifted Hilbert curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

CURVES, AXES, BITS = 20, 12, 5
LEAST = 4           # curves that are used at least; the others as far as they pay
BLOCK = 4096        # points of a curve that lie together: four windows, between a quarter of this and this
WINDOW = 64         # points before and after a query that it meets at least
WHOLE = 1024        # a norm range of so few points is met whole
SAMPLE = 4096       # vectors that fit the grids of a norm range; the index holds all of them
RANGES = 8          # norm ranges, each down to half its largest squared norm; the last takes the rest
TRIALS, RECALL = 128, 0.95      # queries answered in full, and the share of their answers a window must hold
ENOUGH = 100        # answers of the trial in a norm range that choose its curves; with fewer, all ranges' do
ASKS = 4096         # queries that meet a block in one task, about


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with small integer coordinates.

    The coordinates are turned into the curve's transposed index: from the highest bit on,
    reflections and swaps undo the curve's rotation, and a Gray code orders the axes.
    """
    axes = cells.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in axes:
            high = (axis >> bit) & 1 == 1
            swap = np.where(high, 0, (axes[0] ^ axis) & low)
            axes[0] ^= np.where(high, low, swap)
            axis ^= swap
    axes = np.bitwise_xor.accumulate(axes, axis=0)
    turn = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    axes ^= turn
    place = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            place = (place << 1) | ((axis >> bit) & 1)
    return place


class Curves:
    """Random projections, each with a shifted grid fitted to a sample's quantiles."""

    def __init__(self, sample: np.ndarray, reach: float, seed: int):
        random = np.random.default_rng(seed)
        self.reach, width = reach, sample.shape[1] + 1
        axes = min(AXES, width)
        self.planes = [np.linalg.qr(random.normal(size=(width, axes)))[0] for _ in range(CURVES)]
        self.shifts = random.random((CURVES, axes)) / 4
        self.grids = [np.sort(self.lifted(sample, True) @ plane, axis=0) for plane in self.planes]

    def lifted(self, vectors: np.ndarray, indexed: bool) -> np.ndarray:
        """One more coordinate makes the largest inner product the smallest distance.

        The length of a query doesn't matter; it gets that of the lifted points.
        """
        if not indexed:
            vectors = vectors * np.sqrt(self.reach / (vectors ** 2).sum(axis=1))[:, None]
        rest = np.sqrt(np.maximum(self.reach - (vectors ** 2).sum(axis=1), 0)) if indexed else np.zeros(len(vectors))
        return np.column_stack([vectors, rest])

    def keys(self, vectors: np.ndarray, indexed: bool) -> np.ndarray:
        points, found = self.lifted(vectors, indexed), []
        for plane, shift, grid in zip(self.planes, self.shifts, self.grids):
            share = np.column_stack([np.searchsorted(grid[:, k], column) / len(grid)
                                     for k, column in enumerate((points @ plane).T)])
            cells = np.clip(((share * 0.75 + shift) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
            found.append(hilbert(cells, BITS))
        return np.column_stack(found)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as doubles; shorter ones end with zeros."""
    out = np.zeros((len(column), width))
    sizes = column.value_lengths().to_numpy()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def usable(vector: Column) -> Column:
    """Not null, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(frame: DataFrame, id_: str, vector: str, is_query: Column, k: int = 20, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for every query.

    Equal vectors are one point that carries its k + 1 smallest ids, all that any answer can
    take from it.  Points lie on several Hilbert curves of randomly projected, shifted grids.
    Points are parted by norm, and every range has curves of its own, so that a few long vectors
    move nobody else's place.  Every curve is range-partitioned and its points are counted.  A
    query meets the points up to a window before and after its own place on a number of curves;
    both are chosen for each norm range (``LEAST`` curves and ``WINDOW`` points at least; a range of
    ``WHOLE`` points or fewer is met whole), as those that meet the fewest points with which ``TRIALS`` queries find
    ``RECALL`` of their true answers.  It is scored there on the original vectors in double
    precision, and the best of all curves are merged.  Clustered vectors need a few curves and
    short windows whatever the table's size; on evenly spread vectors the window grows with the
    table.  Ties go to the smaller id.

    Rows whose vector isn't usable, and rows without an id, take no part.  Vectors of
    different length count as ending with zeros.  Fewer than k candidates give all of them.
    Grids are fitted to ``SAMPLE`` points of a range; every point is indexed.  An empty table gives an
    empty result.
    """
    spark = frame.sparkSession
    rows = frame.select(frame[f"`{id_}`"].alias("id"), frame[f"`{vector}`"].alias("vec"),
                        F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(usable(F.col("vec")) & F.col("id").isNotNull())
    # Of a vector with any number of copies k + 1 rows pass the first shuffle.
    few = (rows.select("id", "vec").withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("id")))
           .filter(F.col("_n") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    asked = rows.groupBy("vec").agg(F.max("asks").alias("asks"))
    points = stage(few.join(asked, "vec").withColumn("point", F.monotonically_increasing_id()).withColumn(
        "norm", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), "points")
    reach, width = points.agg(F.max("norm"), F.max(F.size("vec"))).first()
    answers = "query_id long, rank int, vec_id long, score double"
    if reach is None:
        return spark.createDataFrame([], answers)
    ranges: list[Curves] = []
    while reach is not None:
        low = reach / 2 if len(ranges) < RANGES - 1 else -1.0
        sample = (points.filter((F.col("norm") <= reach) & (F.col("norm") > low)).orderBy(F.xxhash64("point"), "point")
                  .limit(SAMPLE).select("vec").toArrow()["vec"])
        ranges.append(Curves(_matrix(sample.combine_chunks(), width), reach, seed))
        reach = points.filter(F.col("norm") <= low).agg(F.max("norm")).first()[0]
    curves = spark.sparkContext.broadcast(ranges)
    tops = np.array([r.reach for r in ranges])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, number = _matrix(batch.column("vec"), width), batch.column("point").to_numpy()
            asks = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            place = (batch.column("norm").to_numpy()[:, None] <= tops[1:]).sum(axis=1)
            for r, of_range in enumerate(curves.value):
                names = np.arange(r * CURVES, (r + 1) * CURVES, dtype=np.int32)
                for kind, at in ((0, np.flatnonzero(place == r)), (1, asks)):
                    keys = of_range.keys(vectors[at], kind == 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(names, len(at))), pa.array(keys.ravel()),
                         pa.array(np.full(keys.size, kind, np.int32)), pa.array(np.repeat(number[at], CURVES))],
                        ["curve", "key", "kind", "point"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Count the points of each curve that the sorted partition has had so far."""
        curve_now, seen = -1, 0
        for batch in batches:
            curve = batch.column("curve").to_numpy()
            base = (batch.column("kind").to_numpy() == 0).astype(np.int64)
            starts = np.flatnonzero(np.append(True, np.diff(curve) != 0)) if len(curve) else np.zeros(0, np.int64)
            before = np.cumsum(base) - base
            for start, end in zip(starts, np.append(starts[1:], len(curve))):
                carried = seen if curve[start] == curve_now else 0
                before[start:end] += carried - before[start]
                curve_now, seen = curve[start], int(before[end - 1] + base[end - 1])
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ["curve", "kind", "point", "part"]), pa.array(before)],
                ["curve", "kind", "point", "part", "before"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), CURVES)
    ordered = stage(points.select("vec", "point", "asks", "norm").mapInArrow(along, "curve int, key long, kind int, point long")
                    .repartitionByRange(parts, "curve", "key", "kind", "point")
                    .sortWithinPartitions("curve", "key", "kind", "point")
                    .withColumn("part", F.spark_partition_id())
                    .mapInArrow(numbered, "curve int, kind int, point long, part int, before long"), "curve-order")
    # One row for each curve and part.
    so_far = Window.partitionBy("curve").orderBy("part")
    firsts = (ordered.groupBy("curve", "part").agg(F.sum(1 - F.col("kind")).alias("_n"))
              .withColumn("_first", F.sum("_n").over(so_far) - F.col("_n")).drop("_n"))
    placed = (ordered.join(firsts, ["curve", "part"])
              .select("curve", "kind", "point", (F.col("before") + F.col("_first")).alias("at")))
    chosen = _choices(points, placed, tops, width, k)
    of_range = (F.floor(F.col("curve") / CURVES) + 1).cast("int")
    placed = placed.filter(F.col("curve") % CURVES < F.element_at(F.array(*[F.lit(c) for c, _ in chosen]), of_range))
    window = F.element_at(F.array(*[F.lit(w) for _, w in chosen]), of_range)
    # Blocks go with the window, so a query touches as many at any size of the table.
    block = F.element_at(F.array(*[F.lit(min(max(4 * w, BLOCK // 4), BLOCK)) for _, w in chosen]), of_range)
    asking = (placed.filter("kind = 1").withColumn("reach", window.cast("long"))
              .withColumn("block", F.explode(F.sequence(F.floor(F.greatest(F.col("at") - F.col("reach"), F.lit(0)) / block),
                                                        F.floor((F.col("at") + F.col("reach")) / block)))))
    # A block that many queries meet is dealt to several tasks with a part of them each.
    deals = stage(asking.groupBy("curve", "block").agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("deals")), "deals")
    cells = (asking.join(deals, ["curve", "block"])
             .withColumn("deal", F.pmod(F.xxhash64("point"), F.col("deals")).cast("int")).drop("deals")
             .unionByName(placed.filter("kind = 0").withColumn("reach", F.lit(0).cast("long"))
                          .withColumn("block", F.floor(F.col("at") / block)).join(deals, ["curve", "block"])
                          .withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals"))
             .join(points.select("point", "vec", F.element_at("ids", 1).alias("least")), "point")
             .repartition("curve", "block", "deal").sortWithinPartitions("curve", "block", "deal", "kind", "at"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            kind, number, at = (cell[name].to_numpy() for name in ("kind", "point", "at"))
            vectors, smallest = _matrix(cell["vec"].combine_chunks(), width), cell["least"].to_numpy()
            bases = int(np.searchsorted(kind, 1))
            if bases == 0 or bases == len(kind):
                continue
            reach, places, first = int(cell["reach"][bases].as_py()), at[:bases], bases
            while first < len(at):
                # Queries that lie close together meet the points around them at once.
                end = int(np.searchsorted(at[first:], at[first] + max(reach // 8, 1))) + first
                low, high = np.searchsorted(places, (at[first] - reach, at[end - 1] + reach + 1))
                if low < high:
                    one, other, score = _top(vectors[first:end], vectors[low:high], smallest[low:high], k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(number[first:end][one]), pa.array(number[low:high][other]),
                                                      pa.array(score)], ["asker", "point", "score"])
                first = end

    found = cells.mapInArrow(meet, "asker long, point long, score double")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "least")
    found = (found.groupBy("asker", "point").agg(F.max("score").alias("score"))
             .join(points.select("point", "ids", F.element_at("ids", 1).alias("least")), "point")
             .withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1)
             .select("asker", "score", F.explode("ids").alias("vec_id"))
             .withColumn("_n", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")))
             .filter(F.col("_n") <= k + 1).drop("_n"))
    lists = stage(found.groupBy("asker").agg(F.collect_list(F.struct("score", "vec_id")).alias("hits")), "answers")
    # A query takes its vector's list without itself; a list has k + 1 hits at most.
    asking = (rows.filter("asks").select("id", "vec").distinct()
              .join(points.select("vec", F.col("point").alias("asker")), "vec").select("id", "asker"))
    others = F.filter("hits", lambda h: h["vec_id"] != F.col("id"))
    ranked = F.slice(F.array_sort(others, lambda a, b: F.when(a["score"] > b["score"], -1).when(
        a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1)
        .otherwise(0)), 1, k)
    return (asking.join(lists, "asker").select(F.col("id").alias("query_id"), F.posexplode(ranked).alias("_at", "_hit"))
            .select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_hit.vec_id").alias("vec_id"),
                    F.col("_hit.score").alias("score")))


def _top(asks: np.ndarray, base: np.ndarray, smallest: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of the ``keep`` largest inner products; ties go to the smaller id."""
    keep, found = min(keep, len(base)), []
    for at in range(0, len(asks), 512):
        scores = asks[at:at + 512] @ base.T
        rim = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
        one, other = np.nonzero(scores >= rim[:, None])
        score = scores[one, other]
        order = np.lexsort((smallest[other], -score, one))
        one, other, score = one[order], other[order], score[order]
        best = np.arange(len(one)) - np.searchsorted(one, one) < keep
        found.append((one[best] + at, other[best], score[best]))
    return tuple(map(np.concatenate, zip(*found)))


def _choices(points: DataFrame, placed: DataFrame, tops: np.ndarray, width: int, k: int) -> list[tuple[int, int]]:
    """(curves, window) of each norm range with which ``TRIALS`` queries find ``RECALL`` of their true
    answers there and meet the fewest points; of several the fewest curves.

    An answer is found on the first so many curves if on one of them it is no more points away
    than the window.  More curves allow shorter windows.  Windows that grow with the table do so on
    any number of curves, so tables of one distribution get one number whatever their size.
    """
    below = sum(((F.col("norm") <= F.lit(float(top))).cast("int") for top in tops[1:]), F.lit(0))
    sizes = {r["range"]: r["n"] for r in points.groupBy(below.alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()}
    trial = points.filter("asks").orderBy(F.xxhash64("point"), "point").limit(TRIALS).select("point", "vec").toArrow()
    if not trial.num_rows:
        return [(LEAST, WINDOW)] * len(tops)
    asker, trials = trial["point"].to_numpy(), _matrix(trial["vec"].combine_chunks(), width)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other, score = _top(trials, _matrix(batch.column("vec"), width), batch.column("least").to_numpy(), k + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asker[one]), batch.column("point").take(pa.array(other)), pa.array(score)], ["asker", "point", "score"])

    best = Window.partitionBy("asker").orderBy(F.desc("score"), "point")
    truth = stage(points.select("point", "vec", F.element_at("ids", 1).alias("least"))
                  .mapInArrow(full, "asker long, point long, score double").filter("asker != point")
                  .withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).select("asker", "point"), "trials")
    theirs = placed.filter("kind = 1").select(F.col("point").alias("asker"), "curve", F.col("at").alias("_from"))
    # TRIALS x k answers on every curve of their range.
    away = (placed.filter("kind = 0").join(F.broadcast(truth), "point").join(theirs, ["asker", "curve"])
            .select("asker", "point", "curve", F.abs(F.col("at") - F.col("_from")).alias("far"))
            .orderBy("asker", "point", "curve").toArrow())
    if not away.num_rows:
        return [(LEAST, WINDOW)] * len(tops)
    place = away["curve"].to_numpy()[::CURVES] // CURVES
    nearest_so_far = np.minimum.accumulate(away["far"].to_numpy().reshape(-1, CURVES), axis=1)
    chosen = []
    for r in range(len(tops)):
        mine = nearest_so_far[place == r]
        far = np.quantile(mine if len(mine) >= ENOUGH else nearest_so_far, RECALL, axis=0, method="higher") + 1
        size = sizes.get(r, 0)
        window = np.maximum(np.minimum(far, size), size if size <= WHOLE else WINDOW)
        met = np.arange(1, CURVES + 1) * window
        best = LEAST - 1 + int(np.argmin(met[LEAST - 1:]))
        chosen.append((best + 1, int(window[best])))
    return chosen


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal (curve, block, deal) of a sorted partition, whatever batches they come in."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        cuts = np.flatnonzero(np.logical_or.reduce([np.diff(table[c].to_numpy()) != 0 for c in ("curve", "block", "deal")])) + 1
        start = 0
        for cut in cuts.tolist():
            yield table.slice(start, cut - start)
            start = cut
        held = table.slice(start)
    if held is not None and held.num_rows:
        yield held
