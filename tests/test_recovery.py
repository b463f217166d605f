"""Run logs rebuilt after the driver died between the last commit and ``finish``."""

import pytest
from pyspark.sql import functions as F

from stridemill import fsio
from stridemill.operators import tables as B
from stridemill.schemas import struct
from stridemill.suite.table_queries import scratch_database
from stridemill.session import run_dir
from stridemill.streaming.recovery import rebuilt_log, recover_log
from stridemill.streaming.runs import append_stream, batch_stream, finish

ROWS = struct(id="long")


def land(spark, folder, *sizes, first=0):
    for n, size in enumerate(sizes, first):
        spark.range(n * 100, n * 100 + size).coalesce(1).write.mode("append").parquet(f"{folder}/day {n}")


def stream(spark, folder, one_file=True):
    reader = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", 1) if one_file else reader).parquet(folder)


def scan(spark, folder):
    return spark.read.schema(ROWS).option("recursiveFileLookup", "true").parquet(folder)


def counts(log):
    return [(e["query"], e["batchId"], e["inputRows"], e["outputRows"]) for e in log]


def test_file_sink_log_equals_the_one_that_was_lost(spark):
    work = run_dir(spark, "recover")
    land(spark, f"{work}/in", 3, 5, 7)
    even = stream(spark, f"{work}/in").filter("id % 2 = 0")
    query = append_stream(even, f"{work}/out", f"{work}/checkpoint", "evens")
    lost = finish(query)
    found = rebuilt_log(spark, f"{work}/checkpoint", "evens", scan(spark, f"{work}/in"),
                        spark.read.parquet(f"{work}/out"))
    assert counts(found) == counts(lost) and len(found) == 3
    assert sorted(e["outputRows"] for e in found) == [2, 3, 4]
    assert all(a["timestamp"] <= b["timestamp"] for a, b in zip(lost, found))


def test_only_what_the_table_lacks_is_added(spark):
    work, database = run_dir(spark, "recover"), scratch_database(spark, "recover")
    table = f"{database}.run_log"

    def run(keep):
        query = append_stream(stream(spark, f"{work}/in"), f"{work}/out", f"{work}/checkpoint", "copy")
        query.awaitTermination()
        if keep:
            finish(query).append_to(spark, table)

    def recover(checkpoint="checkpoint"):
        return counts(recover_log(spark, table, f"{work}/{checkpoint}", "copy", scan(spark, f"{work}/in"),
                                  spark.read.parquet(f"{work}/out")))

    land(spark, f"{work}/in", 3, 5)
    run(keep=True)
    assert recover() == []
    land(spark, f"{work}/in", 11, first=2)
    run(keep=False)
    assert recover() == [("copy", 2, 11, 11)] and recover() == []
    assert spark.read.table(table).agg(F.sum("inputRows"), F.count("*")).first() == (19, 3)
    # a checkpoint that is made anew counts its batches from 0 again
    query = append_stream(stream(spark, f"{work}/in", one_file=False), f"{work}/again", f"{work}/fresh", "copy")
    query.awaitTermination()
    assert counts(recover_log(spark, table, f"{work}/fresh", "copy", scan(spark, f"{work}/in"),
                              spark.read.parquet(f"{work}/again"))) == [("copy", 0, 19, 19)]


def test_batches_of_a_callback_stream(spark):
    work = run_dir(spark, "recover")
    land(spark, f"{work}/in", 4, 6)
    written = {}

    def each(batch, name):
        rows = batch.filter("id >= 100")  # the first file has none
        B.append_batch(rows, f"{work}/out", name)
        written[name] = rows.count()

    lost = finish(batch_stream(stream(spark, f"{work}/in"), each, f"{work}/checkpoint", "late"), written)
    found = rebuilt_log(spark, f"{work}/checkpoint", "late", scan(spark, f"{work}/in"), spark.read.parquet(f"{work}/out"))
    # the live log has input rows once for each time the callback read its batch
    assert [(e["batchId"], e["outputRows"]) for e in found] == [(e["batchId"], e["outputRows"]) for e in lost]
    assert sorted((i, o) for _, _, i, o in counts(found)) == [(4, 0), (6, 6)]


def test_a_batch_without_commit_is_left_to_the_next_run(spark):
    work = run_dir(spark, "recover")
    land(spark, f"{work}/in", 4, 6)

    def each(batch, name):
        if batch.first()["id"] >= 100 or batch.first()["id"] == 0 and name.endswith("-1"):
            raise RuntimeError("died")
        B.append_batch(batch, f"{work}/out", name)

    query = batch_stream(stream(spark, f"{work}/in"), each, f"{work}/checkpoint", "cut")
    with pytest.raises(Exception):
        query.awaitTermination()
    found = rebuilt_log(spark, f"{work}/checkpoint", "cut", scan(spark, f"{work}/in"),
                        B.read_batches(spark, f"{work}/out", ROWS))
    assert counts(found) in ([("cut", 0, 4, 4)], [])


def test_nothing_ran_and_older_batches_were_purged(spark):
    work = run_dir(spark, "recover")
    land(spark, f"{work}/in", 1, 2, 3)
    assert rebuilt_log(spark, f"{work}/checkpoint", "x", scan(spark, f"{work}/in"), spark.range(0)) == []
    finish(append_stream(stream(spark, f"{work}/in"), f"{work}/out", f"{work}/checkpoint", "x"))
    for kind in ("offsets", "commits"):
        fsio.delete(spark, f"{work}/checkpoint/{kind}/0")
    found = rebuilt_log(spark, f"{work}/checkpoint", "x", scan(spark, f"{work}/in"),
                        spark.read.parquet(f"{work}/out"))
    # the oldest retained batch only bounds the next
    assert [(b, i, o) for _, b, i, o in counts(found)] == [(2, 3, 3)]
