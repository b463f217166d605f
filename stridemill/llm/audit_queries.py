"""Query of the filter audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filter_audit import audit, repeats, row_totals, term_shards
from .native_queries import documents


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over whole documents in all 120 orders, for every language.

    Documents without an id have no labels and are repeats of any document with one and an
    equal text.  A document with several labels is good or toxic if one of them says so.
    """
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text", F.sha2(text.cast("binary"), 256).alias("digest"),
        (F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 3).alias("capitals"),
        text.rlike(r"[#$%&*|]").alias("symbols"))
    shards, _ = term_shards(docs, "text")
    counted = repeats(row_totals(shards).select("row.*", "n_words", "n_distinct"), "doc_id", "digest")
    labels = (spark.read.parquet(f"{sf_dir}/labels.parquet").filter("doc_id is not null").groupBy("doc_id")
              .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    return audit(counted.join(labels, "doc_id", "left"), "part", {
        "A": F.col("n_words") < 200, "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": F.col("capitals"), "D": F.col("symbols"), "E": F.col("repeated"),
    }, {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})


QUERIES = {"op11_filter_audit": op11_filter_audit}

ORACLE = {"op11_filter_audit": r"""
    with recursive words as (
        select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
               coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
    firsts as (select coalesce(text, '') as t, min(doc_id) as first from documents group by 1),
    good as (select distinct doc_id from labels where quality = 1),
    toxic as (select distinct doc_id from labels where toxic = 1),
    docs as (
        select part, doc_id in (select doc_id from good) as good, doc_id in (select doc_id from toxic) as toxic,
               list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: case f
                   when 'A' then len(w) < 200
                   when 'B' then 100 * len(list_distinct(w)) < 50 * len(w)
                   when 'C' then 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)
                   when 'D' then regexp_matches(t, '[#$%&*|]')
                   else doc_id > first end) as fails
        from words join firsts using (t)),
    orders as (
        select '' as o union all
        select o || f from orders, unnest(['A', 'B', 'C', 'D', 'E']) as u(f) where not contains(o, f)),
    steps as (select o, s, substr(o, s, 1) as own, string_split(substr(o, 1, s - 1), '') as before
              from orders, generate_series(1, 5) as g(s) where length(o) = 5),
    met as (select part, o, s, good, toxic, fails, list_has_any(fails, before) as gone, list_contains(fails, own) as fail
            from docs, steps),
    counts as (
        select part, o as filter_order, s as step, count(*) filter (not gone and not fail) as kept,
               count(*) filter (not gone and fail) as removed, count(*) filter (gone and fail) as redundant,
               count(*) filter (fail and len(fails) = 1) as unique_fails,
               count(*) filter (not gone and fail and good) as good_lost,
               count(*) filter (not gone and fail and toxic) as toxic_lost
        from met group by 1, 2, 3)
    select part, filter_order, cast(step as integer) as step, kept, removed, redundant, unique_fails, good_lost,
           toxic_lost, cast(sum(removed) over (partition by part, substr(filter_order, step, 1)) as bigint) as shapley
    from counts"""}
