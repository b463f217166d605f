import random

import pytest

from conftest import listed
from stridemill import fsio
from stridemill.operators import filters
from stridemill.operators import merge as M
from stridemill.operators import tables as B
from stridemill.session import run_dir

INSERT = "a long, b long, v string"
UPSERT = "k long, day string, v string, part string"


def insert(spark, target, rows, batch, **options):
    return M.merge_insert(spark.createDataFrame(rows, INSERT), target, ["a", "b"], batch, **options)


def test_insert_keeps_existing_and_replays_are_harmless(spark):
    target = run_dir(spark, "insert")
    assert insert(spark, target, [(1, 1, "old"), (2, 1, "old"), (None, 1, "old")], 0)
    for _ in range(3):
        insert(spark, target, [(2, 1, "new"), (3, 1, "new"), (None, 1, "new")], 1, prune_by="a")
    schema = spark.createDataFrame([], INSERT).schema
    assert listed(B.snapshot(spark, target, schema)) == listed(
        spark.createDataFrame([(1, 1, "old"), (2, 1, "old"), (3, 1, "new"), (None, 1, "old")], INSERT))


def test_insert_with_plain_equality_adds_null_keys(spark):
    target = run_dir(spark, "insert")
    insert(spark, target, [(None, 1, "old")], 0)
    for _ in range(2):
        insert(spark, target, [(None, 1, "new")], 1, null_safe=False)
    assert spark.read.parquet(target).count() == 2


def test_insert_overwrites_an_unfinished_batch(spark):
    target = run_dir(spark, "insert")
    insert(spark, target, [(1, 1, "x")], 0)
    insert(spark, target, [(2, 1, "half")], 1)
    fsio.delete(spark, f"{B.batch_path(target, 1)}/_SUCCESS")  # as if the writer had died
    insert(spark, target, [(2, 1, "whole"), (3, 1, "whole")], 1)
    assert listed(spark.read.parquet(target).select("a", "v")) == [(1, "x"), (2, "whole"), (3, "whole")]


def test_dynamic_keys_and_view(spark):
    target = run_dir(spark, "insert")
    batch = spark.createDataFrame([(1, 1, "x")], INSERT)
    assert M.upsert_data(batch, 0, target, ["a"], "merge_view")
    assert spark.sql("SELECT v FROM merge_view").collect() == [("x",)]
    assert not M.upsert_data(batch, 0, target, ["a"])


def upsert(spark, target, rows, batch, **options):
    return M.merge_upsert(spark.createDataFrame(rows, UPSERT), target, ["k", "day"], ["part"], batch,
                          order_cols=["v"], **options)


def content(spark, target):
    return listed(B.snapshot(spark, target, spark.createDataFrame([], UPSERT).schema))


def model(table, rows):
    """Brute force: complete keys replace, partial keys stay unless identical."""
    def rank(row):  # descending order puts NULL last
        return [(v is not None, v or "") for v in row[2:]]

    complete = {}
    for row in rows:
        if None not in row[:2] and (row[:2] not in complete or rank(row) > rank(complete[row[:2]])):
            complete[row[:2]] = row
    kept = [r for r in table if r[:2] not in complete]
    partial = [r for r in rows if None in r[:2] and r not in table]
    return kept + list(complete.values()) + partial


def test_upsert_equals_brute_force_over_batches(spark):
    rng, target, table = random.Random(11), run_dir(spark, "upsert"), []
    for batch in range(3):
        rows = [(rng.choice([None, *range(8)]), rng.choice(["d1", "d2"]), f"v{rng.randrange(9)}",
                 rng.choice(["p/1", "p2", None])) for _ in range(25)]
        for _ in range(2 if batch else 1):  # replays
            upsert(spark, target, rows, batch, prune_by="day")
        table = model(table, rows)
        assert content(spark, target) == listed(spark.createDataFrame(table, UPSERT))


def test_update_moves_a_row_and_empties_its_folder(spark):
    target = run_dir(spark, "upsert")
    upsert(spark, target, [(1, "d", "a", "old"), (2, "d", "a", "stay")], 0)
    assert upsert(spark, target, [(1, "d", "b", "new")], 1) == 1
    assert content(spark, target) == [(1, "d", "b", "new"), (2, "d", "a", "stay")]
    assert not fsio.exists(spark, f"{target}/part=old/_batch_id=0")


def test_pure_insert_rewrites_nothing(spark):
    target = run_dir(spark, "upsert")
    upsert(spark, target, [(1, "d", "a", "p")], 0)
    before = fsio.children(spark, f"{target}/part=p/_batch_id=0")
    assert upsert(spark, target, [(2, "d", "a", "p")], 1) == 0
    assert fsio.children(spark, f"{target}/part=p/_batch_id=0") == before


def test_crash_while_folders_are_moved(spark, monkeypatch):
    target = run_dir(spark, "upsert")
    upsert(spark, target, [(1, "d", "a", "p"), (2, "d", "a", "q")], 0)
    rows = [(1, "d", "b", "q"), (3, "d", "b", "p")]

    moves, rename = [], M.fsio.rename

    def dies_at_second(session, source, destination):
        if "/rows/" in source:
            moves.append(source)
        if len(moves) == 2:
            raise RuntimeError("lost driver")
        rename(session, source, destination)

    with monkeypatch.context() as patch:
        patch.setattr(M.fsio, "rename", dies_at_second)
        with pytest.raises(RuntimeError):
            upsert(spark, target, rows, 1)
    upsert(spark, target, rows, 1)
    assert content(spark, target) == [(1, "d", "b", "q"), (2, "d", "a", "q"), (3, "d", "b", "p")]


def test_other_file_system_gets_a_copy(spark, monkeypatch):
    target = run_dir(spark, "upsert")
    upsert(spark, target, [(1, "d", "a", "p"), (2, "d", "a", "q")], 0)
    monkeypatch.setattr(M.fsio, "same_file_system", lambda *_: False)
    for _ in range(2):
        upsert(spark, target, [(1, "d", "b", "q"), (3, "d", "b", "p")], 1)
    assert content(spark, target) == [(1, "d", "b", "q"), (2, "d", "a", "q"), (3, "d", "b", "p")]


def test_null_keys_can_always_insert(spark):
    target = run_dir(spark, "upsert")
    upsert(spark, target, [(None, "d", "a", "p")], 0)
    upsert(spark, target, [(None, "d", "a", "p")], 1, null_keys="insert")
    assert len(content(spark, target)) == 2
    with pytest.raises(ValueError):
        upsert(spark, target, [], 2, null_keys="other")


def test_groups_are_replaced_whole(spark):
    target = run_dir(spark, "groups")
    upsert(spark, target, [(1, "d1", "a", "p"), (1, "d2", "a", "p"), (None, "d1", "a", "p")], 0)
    fresh = spark.createDataFrame([(1, "d1", "x", "q"), (1, "d1", "y", "p"), (None, "d1", "z", "p")], UPSERT)
    for _ in range(2):
        M.merge_groups(fresh, target, ["k", "day"], ["part"], 1)
    assert content(spark, target) == listed(spark.createDataFrame(
        [(1, "d2", "a", "p"), (1, "d1", "x", "q"), (1, "d1", "y", "p"), (None, "d1", "z", "p")], UPSERT))


def test_value_range(spark):
    df = spark.createDataFrame([(3,), (None,), (7,)], "x long")
    probe = spark.createDataFrame([(2,), (3,), (5,), (7,), (8,), (None,)], "x long")
    assert listed(probe.filter(filters.value_range(df, "x"))) == [(3,), (5,), (7,), (None,)]
    assert listed(probe.filter(filters.value_range(df.filter("x is null"), "x"))) == [(None,)]
    assert probe.filter(filters.value_range(df.filter("false"), "x")).isEmpty()


def test_merged_tables_are_seen_through_the_catalog(spark):
    folder = run_dir(spark, "merge_db")
    spark.sql(f"CREATE DATABASE merge_db LOCATION '{folder}'")
    for batch, rows in enumerate(([(1, 1, "x"), (2, 1, "x")], [(2, 1, "y"), (3, 1, "y")])):
        insert(spark, f"{folder}/i", rows, batch, catalog_table="merge_db.inserted")
    assert listed(spark.read.table("merge_db.inserted").select("a", "v")) == [(1, "x"), (2, "x"), (3, "y")]
    table = []
    for batch, rows in enumerate(([(1, "d", "a", "p/1"), (2, "d", "a", "it's"), (None, "d", "a", None)],
                                  [(1, "d", "b", "it's"), (4, "d", "b", "p/1")], [(2, "d", "c", "it's")])):
        for _ in range(2):
            upsert(spark, f"{folder}/u", rows, batch, catalog_table="merge_db.upserted")
        table = model(table, rows)
        assert listed(spark.read.table("merge_db.upserted").select("k", "day", "v", "part")) == listed(
            spark.createDataFrame(table, UPSERT))


def test_readers_see_a_partition_before_or_after_an_interrupted_publish(spark, monkeypatch):
    folder = run_dir(spark, "switch_db")
    spark.sql(f"CREATE DATABASE switch_db LOCATION '{folder}'")
    name, first = "switch_db.t", [(1, "d", "a", "p"), (2, "d", "a", "q")]
    upsert(spark, f"{folder}/t", first, 0, catalog_table=name)
    rows = [(1, "d", "b", "p"), (2, "d", "b", "q")]

    def read():
        return [r[0] for r in spark.read.table(name).orderBy("k").select("v").collect()]

    real, seen = B.SparkSession.sql, []

    def watched(session, text, *args, **kwargs):
        out = real(session, text, *args, **kwargs)
        if text.startswith("ALTER TABLE") and session is spark:
            by_part = {}
            for r in real(session, f"SELECT part, k, v FROM {name}").collect():
                by_part.setdefault(r.part, []).append((r.k, r.v))
            seen.append(by_part)
        return out

    with monkeypatch.context() as patch:
        patch.setattr(type(spark), "sql", watched)
        upsert(spark, f"{folder}/t", rows, 1, catalog_table=name)
    assert read() == ["b", "b"] and seen
    for part, key in (("p", 1), ("q", 2)):
        for by_part in seen:  # old rows or new rows; while a batch's folder is added, never none
            assert by_part[part] and set(by_part[part]) <= {(key, "a"), (key, "b")}


def test_partitioned_insert_replays_and_prunes(spark):
    target = run_dir(spark, "months")
    rows = spark.createDataFrame([(1, 1, "x", "2024-01"), (2, 1, "x", "2024-02")], INSERT + ", m string")
    more = spark.createDataFrame([(2, 1, "y", "2024-02"), (3, 1, "y", "2024-02")], INSERT + ", m string")
    for batch, frame in ((0, rows), (1, more), (1, more)):
        M.merge_insert(frame, target, ["a", "b"], batch, prune_by="m", partitions=["m"])
    assert listed(B.snapshot(spark, target, rows.schema)) == [
        (1, 1, "x", "2024-01"), (2, 1, "x", "2024-02"), (3, 1, "y", "2024-02")]
    assert filters.value_set(rows, "m") is not None
