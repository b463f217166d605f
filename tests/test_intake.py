"""Undeclared fields inside arrays, and archiving in tasks."""

import json
import os

import pytest

from conftest import listed
from stridemill import fsio
from stridemill.operators import tables as B
from stridemill.schemas import struct
from stridemill.session import run_dir
from stridemill.sources import bronze as I
from stridemill.sources import moving
from stridemill.sources.bronze import BronzeLoader, archive_landing
from stridemill.sources.evolution import SchemaStore, conform, parse_lines

LAPS = "id long, laps array<struct<lap:long, km:double, at:struct<x:long>, cuts:array<struct<s:long>>>>, tags array<long>"


def land(folder, name, *documents):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as out:
        out.write("\n".join(json.dumps(d) for d in documents))


@pytest.mark.parametrize("laps, rescued", [
    ([{"lap": 1, "km": 1.5}], False), ([], False), (None, False), ([None, {"lap": 1}], False),
    ([{"lap": 1}, {"lap": 2, "pulse": 90}], True), ([{"at": {"x": 1, "y": 2}}], True), ([{"cuts": [{"s": 1}, {"s": 2, "t": 0}]}], True),
    ([{"lap": 1.5}], True), ([{"km": 12345678901234567}], True), ([{"lap": "x"}], True), ("text", True), ({"lap": 1}, True),
])
def test_fields_inside_arrays_are_not_lost(spark, laps, rescued):
    schema = spark.createDataFrame([], LAPS).schema
    line = json.dumps({"id": 1, "laps": laps, "tags": [1, 2]}, separators=(",", ":"))
    row = conform(parse_lines(spark.createDataFrame([(line,)], "value string")), schema).collect()[0]
    assert (row.id, row.tags) == (1, [1, 2])
    assert (row._rescued_data is not None) == rescued
    if rescued:
        assert json.loads(row._rescued_data) == {"laps": laps}


def test_numbers_in_plain_arrays(spark):
    schema = spark.createDataFrame([], LAPS).schema
    lines = spark.createDataFrame([('{"id":1,"tags":[1,2.5]}',), ('{"id":2.5,"tags":[]}',)], "value string")
    assert [(r.id, r._rescued_data) for r in conform(parse_lines(lines), schema).collect()] == [
        (1, '{"tags":[1,2.5]}'), (None, '{"id":2.5}')]


def test_arrays_evolve(spark):
    work = run_dir(spark, "laps")
    loader = BronzeLoader(f"{work}/landing", f"{work}/checkpoint", "json", spark=spark)
    land(f"{work}/landing", "a.json", {"id": 1, "laps": [{"lap": 1}]})
    loader.load_evolving(f"{work}/bronze")
    land(f"{work}/landing", "b.json", {"id": 2, "laps": [{"lap": 1}, {"lap": 2, "pulse": 90, "cuts": [{"s": 1}]}]}, {"id": 3, "laps": [{"lap": 1.5}]})
    loader.load_evolving(f"{work}/bronze")
    stored = SchemaStore(spark, loader.schema_path).load()
    assert stored["laps"].dataType.simpleString() == "array<struct<lap:bigint,cuts:array<struct<s:bigint>>,pulse:bigint>>"
    rows = B.snapshot(spark, f"{work}/bronze", stored.add("_rescued_data", "string"))
    assert listed(rows.selectExpr("id", "laps.pulse", "get(get(laps.cuts, 1), 0).s", "_rescued_data")) == listed(spark.createDataFrame(
        [(1, [None], None, None), (2, [None, 90], 1, None), (3, [None], None, '{"laps":[{"lap":1.5}]}')],
        "id long, p array<long>, s long, r string"))


def landing_of(spark, label, count):
    work = run_dir(spark, label)
    loader = BronzeLoader(f"{work}/in", f"{work}/checkpoint", "json", declared=struct(id="long"), spark=spark)
    for k in range(count):
        land(f"{work}/in/d={k % 3}", f"f {k}%.json", {"id": k})
    open(f"{work}/in/d=0/.f 0%.json.crc", "w").close()
    loader.write_to_bronze(loader.read_autoloader(), f"{work}/bronze")
    return work, loader


def names(folder):
    return sorted(os.path.relpath(f"{d}/{f}", folder) for d, _, files in os.walk(folder) for f in files)


@pytest.mark.parametrize("in_tasks", [True, False])
def test_archive_in_tasks_and_by_the_driver(spark, monkeypatch, in_tasks):
    if not in_tasks:
        monkeypatch.setattr(I, "reachable", lambda uri: False)
    work, loader = landing_of(spark, "many", 40)
    before = names(f"{work}/in")
    land(f"{work}/in/d=0", "late.json", {"id": 99})
    assert archive_landing(spark, f"{work}/in", f"{work}/old", f"{work}/checkpoint") == 40
    assert [n for n in names(f"{work}/old") if n.endswith(".json")] == [n for n in before if n.endswith(".json")]
    assert [n for n in names(f"{work}/in") if n.endswith(".json")] == ["d=0/late.json"]
    assert not os.path.exists(f"{work}/in/d=0/.f 0%.json.crc") or not in_tasks
    # a name that lands again was not read; nothing is moved twice
    land(f"{work}/in/d=1", "f 1%.json", {"id": 1})
    assert archive_landing(spark, f"{work}/in", f"{work}/old", f"{work}/checkpoint") == 0
    loader.write_to_bronze(loader.read_autoloader(), f"{work}/bronze")
    assert archive_landing(spark, f"{work}/in", f"{work}/later", f"{work}/checkpoint") == 1
    assert names(f"{work}/later")[-1] == "d=0/late.json" and os.path.exists(f"{work}/in/d=1/f 1%.json")


def test_archive_that_dies_in_the_middle(spark):
    work, _ = landing_of(spark, "dies", 30)
    os.makedirs(f"{work}/old")
    open(f"{work}/old/d=2", "w").close()  # a third of the files cannot be moved
    with pytest.raises(Exception, match="d=2"):
        archive_landing(spark, f"{work}/in", f"{work}/old", f"{work}/checkpoint")
    assert not fsio.data_files(spark, f"{work}/checkpoint-archived") or not [
        p for p in fsio.data_files(spark, f"{work}/checkpoint-archived") if fsio.is_committed(spark, p)]
    os.rename(f"{work}/old/d=2", f"{work}/aside")
    assert archive_landing(spark, f"{work}/in", f"{work}/old", f"{work}/checkpoint") == 30
    assert len([n for n in names(f"{work}/old") if n.endswith(".json")]) == 30


def test_places_that_arrow_cannot_open():
    assert not moving.reachable("viewfs://store/in") and not moving.reachable("file:/no/such/folder") and moving.reachable("file:/tmp")
