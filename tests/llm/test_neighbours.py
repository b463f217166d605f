import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridemill.llm import neighbours
from stridemill.llm.neighbours import hilbert, nearest
from stridemill.llm.vector_queries import op10_nearest_neighbours

VECTORS = "vec_id long, embedding array<float>, label int, vec string, ids string"


def brute(rows, k, every):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v
            and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            scored = sorted((-float(np.dot(v, w)), j) for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def compare(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {i for i, hits in want.items() if hits}
    hits = 0
    for i, rows in found.items():
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(want[i]) + 1))
        assert rows == sorted(rows, key=lambda r: (-r.score, r.vec_id))
        hits += len({r.vec_id for r in rows} & {j for j, _ in want[i]})
    return hits / max(1, sum(map(len, want.values())))


def table(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 0, "v", "i") for i, v in rows], VECTORS)


def test_small_tables_are_exact_with_ties_and_unusable_vectors(spark, as_tables):
    draw = random.Random(2)
    rows = [(i, [round(draw.gauss(0, 1), 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(60)]
    rows += [(400, None), (420, [0.0] * 6), (440, [1.0, None, 0, 0, 0, 0]), (460, [float("nan")] * 6), (480, [float("inf")] + [0.0] * 5),
             (None, [9.0] * 6), (500, []), (521, [1.0, 2.0])]
    got = op10_nearest_neighbours(spark, as_tables(embeddings=table(spark, rows).repartition(4))).collect()
    want = brute([(i, v and v + [0.0] * (6 - len(v))) for i, v in rows], 20, 20)
    assert compare(got, want) == 1
    for r in got:
        assert r.score == pytest.approx(dict(want[r.query_id])[r.vec_id], abs=1e-12)


def test_recall_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 128)
    monkeypatch.setattr(neighbours, "WINDOW", 128)
    monkeypatch.setattr(neighbours, "WHOLE", 64)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + draw.normal(size=24)).tolist()) for i in range(3000)]
    got = nearest(table(spark, rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    assert compare(got, brute(rows, 20, 20)) >= 0.9


def test_norms_differ(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 128)
    monkeypatch.setattr(neighbours, "WINDOW", 128)
    monkeypatch.setattr(neighbours, "WHOLE", 64)
    draw = np.random.default_rng(4)
    rows = [(i, (draw.normal(size=8) * draw.lognormal(0, 1)).tolist()) for i in range(2000)]
    got = nearest(table(spark, rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    assert compare(got, brute(rows, 20, 20)) >= 0.9


def even(seed, n):
    draw = np.random.default_rng(seed)
    vectors = draw.normal(size=(n, 64))
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def test_an_outlier_norm_costs_no_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "WINDOW", 16)
    monkeypatch.setattr(neighbours, "WHOLE", 64)
    plain = even(6, 3000)
    longer = plain.copy()
    longer[7] *= 10
    found = []
    for vectors in (plain, longer):
        rows = list(enumerate(vectors.tolist()))
        got = nearest(table(spark, rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
        found.append(compare(got, brute(rows, 20, 20)))
    assert found[1] >= found[0] - 0.03, found


@pytest.mark.parametrize("outlier", [False, True])
def test_recall_on_even_vectors_where_the_least_window_is_a_few_percent(spark, monkeypatch, outlier):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "WINDOW", 16)
    monkeypatch.setattr(neighbours, "WHOLE", 64)
    vectors = even(6, 5000)
    if outlier:
        vectors[7] *= 10
    rows = list(enumerate(vectors.tolist()))
    got = nearest(table(spark, rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    assert compare(got, brute(rows, 20, 20)) >= 0.9


def test_clustered_vectors_take_few_curves_and_short_windows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WINDOW", 16)
    monkeypatch.setattr(neighbours, "WHOLE", 64)
    draw, chosen = np.random.default_rng(8), []
    centres = draw.normal(size=(200, 32))
    vectors = centres[draw.integers(0, 200, 6000)] + draw.normal(size=(6000, 32)) * 0.2
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    plain = neighbours._choices
    monkeypatch.setattr(neighbours, "_choices", lambda *given: chosen.append(plain(*given)) or chosen[-1])
    rows = list(enumerate(vectors.tolist()))
    got = nearest(table(spark, rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    assert compare(got, brute(rows, 20, 20)) >= 0.9
    (curves, window), = chosen[0]
    assert neighbours.LEAST <= curves < neighbours.CURVES and curves * 2 * window < 0.3 * len(rows), chosen


def test_many_queries_at_one_place_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ASKS", 50)
    monkeypatch.setattr(neighbours, "BLOCK", 256)
    draw = np.random.default_rng(9)
    rows = list(enumerate((np.ones(8) + draw.normal(size=(1200, 8)) * 0.01).tolist()))
    got = nearest(table(spark, rows), "vec_id", "embedding", F.lit(True), k=5).collect()
    assert compare(got, brute(rows, 5, 1)) >= 0.9


def test_few_candidates_and_none(spark, as_tables):
    got = nearest(table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])]), "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5)]
    assert nearest(table(spark, [(0, [1.0])]), "vec_id", "embedding", F.lit(True)).collect() == []
    assert op10_nearest_neighbours(spark, as_tables(embeddings=table(spark, []))).collect() == []


def test_hilbert_steps_to_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        places = hilbert(cells, bits)
        assert sorted(places) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(axis=1) == 1).all()
