"""What a task of the filter audit holds does not depend on how much lies in a file."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stridemill.llm.filter_audit import ROW_BYTES, SHARD_BYTES, row_totals, term_shards

DOCS, WORDS = 48, 90_000


@pytest.fixture(scope="module")
def one_file(spark):
    """Shards of some 25 MB of text in one partition, each text of many words of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    word = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: (F.col("id") * 60_000 + k).cast("string"))
    yield term_shards(spark.range(0, DOCS, 1, 1).select(F.col("id").alias("doc_id"), F.array_join(word, " ").alias("text")), "text")
    spark.conf.set(key, before)


def test_rows_and_row_groups_are_small(one_file):
    shards, dictionary = one_file

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])
    seen = shards.mapInArrow(run, "n long, size long").collect()
    assert sum(r.n for r in seen) == shards.count() > 8
    assert max(r.size for r in seen) < 4 * SHARD_BYTES
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in shards.inputFiles()]
    assert sum(f.num_row_groups for f in files) > 1
    assert all(sum(g.column(c).total_compressed_size for c in range(g.num_columns)) < 24 << 20
               for f in files for g in (f.row_group(k) for k in range(f.num_row_groups)))
    assert dictionary.count() == (DOCS - 1) * 60_000 + WORDS


def test_one_python_worker_sums_the_rows(one_file):
    totals = row_totals(one_file[0])
    assert totals._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [(r.n_words, r.n_distinct) for r in totals.collect()] == [(WORDS, WORDS)] * DOCS


def test_rows_without_words_fill_shards_too(spark):
    n = 5 * SHARD_BYTES // ROW_BYTES
    shards, dictionary = term_shards(spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")), "text")
    sizes = [r.n for r in shards.select(F.size("rows").alias("n")).collect()]
    assert sum(sizes) == n and max(sizes) <= SHARD_BYTES // ROW_BYTES and dictionary.count() == 0
    totals = row_totals(shards)
    assert totals.filter("n_words = 0 and n_distinct = 0").select("row.doc_id").distinct().count() == n


def test_chunks_without_words_keep_their_rows(spark):
    text = F.when(F.col("id") % 12_000 == 11_999, F.lit("a b a"))
    shards, dictionary = term_shards(spark.range(0, 36_000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text")), "text")
    totals = row_totals(shards).select("row.*", "n_words", "n_distinct")
    assert totals.count() == totals.select("doc_id").distinct().count() == 36_000
    assert sorted(map(tuple, totals.filter("n_words > 0").collect())) == [(11_999, 3, 2), (23_999, 3, 2), (35_999, 3, 2)]
    assert sorted(bytes(r.word) for r in dictionary.collect()) == [b"a", b"b"]
