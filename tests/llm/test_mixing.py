import random
import re
from collections import defaultdict

import pytest

from stridemill.llm.mixing import mix, repeated, water_fill
from stridemill.llm.native_queries import op3_mixing


def filled(sizes, weights=(5.0, 2.0, 1.0), budget=1.5, most=2.0):
    """Targets by the clamping loop: share, clamp, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), budget * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_the_clamping_loop(spark, seed):
    draw = random.Random(seed)
    sizes = {draw.choice("abcDEé") + str(i): draw.choice([0, 1, 10, 1000, draw.randrange(5000)]) for i in range(9)}
    sizes[None] = 77
    rows = water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = filled(sizes)
    assert len(rows) == len(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source], abs=1e-6)


def test_query_on_a_small_table(spark, make_docs, as_tables):
    draw = random.Random(5)
    rows = [(i, " ".join(["w"] * draw.choice([1, 5, 20, 90])), "en", draw.choice(["a", "b", "c", "d", "e", None]))
            for i in range(1500)]
    rows += [(5000, " w" * 4000, "en", "a"), (5001, None, "en", "a"), (5002, "", None, None), (None, "x y", None, "b"),
             (7, rows[7][1], "en", rows[7][3])]
    folder = as_tables(documents=make_docs(rows).repartition(5))
    got = op3_mixing(spark, folder).collect()
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows]
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(row[0]), n) for row, n in zip(rows, sizes))
    by_source = defaultdict(int)
    for (_, _, _, s), n in zip(rows, sizes):
        by_source[s] += n
    want, taken, size_of = filled(by_source), defaultdict(int), {}
    source = {i: s for i, _, _, s in rows}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        taken[source[r.doc_id]] += r.taken
        size_of[source[r.doc_id]] = r.source_size
    assert size_of == by_source
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(50, 0.01 * target), s
    assert sorted(map(str, got)) == sorted(map(str, op3_mixing(spark, folder).collect()))


def test_one_large_row_leaves_its_miss_to_the_small_ones(spark):
    rows = [(0, "a", 5000)] + [(i, "a", 10) for i in range(1, 1001)] + [(i, "b", 10) for i in range(2000, 2400)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mix(frame, ["doc_id"], weights=(1.0, 3.0)).collect()
    taken = sum(r.row["size"] * r.repeats for r in got if r.row["source"] == "a")
    target = next(r.target for r in got if r.row["source"] == "a")
    assert abs(taken - target) <= 10


def test_no_words_and_no_rows(spark, make_docs, as_tables):
    assert [r.taken for r in op3_mixing(spark, as_tables(documents=make_docs([(1, None, None, None), (2, "", "x", "a")]))).collect()] == [0, 0]


def test_empty_table(spark, make_docs, as_tables):
    assert op3_mixing(spark, as_tables(documents=make_docs([]))).collect() == []


def test_repeats_become_rows_with_all_columns(spark, make_docs):
    docs = make_docs([(i, "a b c", "en", "s") for i in range(40)])
    sized = docs.withColumn("size", docs.n_chars)
    mixed = mix(sized, ["doc_id"])
    out = repeated(mixed)
    assert out.columns == docs.columns
    assert out.count() == sum(r.repeats for r in mixed.collect()) == 60
