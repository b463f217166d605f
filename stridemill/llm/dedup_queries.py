"""Query of near-duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .native_queries import documents
from .near_duplicates import near_duplicates


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component over 4-word shingles; the smallest id stays.

    Documents without an id have no component and stay.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return near_duplicates(docs, "doc_id", "text", width=4, percent=80).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


QUERIES = {"op1_near_dedup": op1_near_dedup}

ORACLE = {"op1_near_dedup": r"""
    with recursive split as (
        select doc_id, coalesce(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w
        from documents),
    grams as (
        select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2),
            lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3])) when len(w) > 0 then [array_to_string(w, ' ')]
            else [] end) as g from split),
    sizes as (select doc_id, count(g) as n from split left join grams using (doc_id) group by doc_id),
    pairs as (select a.doc_id as x, b.doc_id as y, count(*) as both_have
              from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
    links as (select x, y from pairs join sizes s on s.doc_id = x join sizes t on t.doc_id = y
              where 100 * both_have >= 80 * (s.n + t.n - both_have)),
    sides as (select x, y from links union all select y, x from links),
    reached as (select doc_id as x, doc_id as y from documents
                union select r.x, s.y from reached r join sides s on r.y = s.x)
    select doc_id, n as n_shingles, min(y) as component_id, min(y) = doc_id as kept
    from sizes join reached on x = doc_id group by doc_id, n"""}
