import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from stridemill.llm.native_queries import op8_sharding
from stridemill.llm.sharding import shard, write_shards


def test_query_deals_evenly_and_in_proportion(spark, make_docs, as_tables):
    draw = random.Random(3)
    rows = [(i, "t%d é" % (i % 50), "en", draw.choice(["a"] * 6 + ["b"] * 3 + [None])) for i in range(4003)]
    rows += [(9, None, None, None), (None, "", None, "b"), (5, "same", None, "a"), (5, "same", None, "a")]
    got = op8_sharding(spark, as_tables(documents=make_docs(rows).repartition(4))).collect()
    assert len(got) == len(rows)
    per = Counter(r.shard for r in got)
    assert set(per) == set(range(40)) and max(per.values()) - min(per.values()) <= 1
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))
    totals = Counter(r.source for r in got)
    for source, total in totals.items():
        for s in range(40):
            mine = sum(r.source == source for r in got if r.shard == s)
            assert abs(mine - total / 40) <= 2
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_fewer_rows_than_shards_and_none(spark, make_docs):
    few = shard(make_docs([(1, "a", "en", "s"), (2, "b", "en", "s")]), ["doc_id"], shards=5).collect()
    assert sorted(r.slot for r in few) == [0, 0] and len({r.shard for r in few}) == 2
    assert shard(make_docs([]), ["doc_id"]).collect() == []


def test_written_shards_hold_every_row(spark, make_docs, tmp_path):
    docs = make_docs([(i, "t", "en", "s") for i in range(100)])
    path = f"{tmp_path}/shards"
    write_shards(shard(docs, ["doc_id"], shards=7), path)
    back = spark.read.parquet(path)
    assert back.count() == 100 and back.select("_shard").distinct().count() == 7
    assert back.groupBy("_shard").agg(F.max("_slot").alias("m")).filter("m > 14").count() == 0
