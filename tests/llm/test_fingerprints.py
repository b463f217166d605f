import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stridemill.llm.fingerprints import AT_LEAST, as_text, containment, merged, shingle_hashes, sketch
from stridemill.llm.native_queries import op6_fingerprints


def prose(draw, n):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6))) for _ in range(n))


def grams(text):
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    padded = [""] * 4 + words
    return {tuple(padded[i:i + 5]) for i in range(len(words))}


def test_query_against_plain_python(spark, make_docs, as_tables):
    draw = random.Random(1)
    texts = [prose(draw, draw.choice([1, 3, 30, 400])) for _ in range(40)]
    rows = [(i * 3, t, "en", "s") for i, t in enumerate(texts)] + [(200, None, None, None), (201, "", None, None), (202, texts[3], None, None)]
    draw.shuffle(rows)
    got = {r.doc_id: r for r in op6_fingerprints(spark, as_tables(documents=make_docs(rows).repartition(3))).collect()}
    order = sorted((i, t or "") for i, t, _, _ in rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + nxt[:cut]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == edited:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
        a, b = grams(t), grams(edited)
        if len(a) >= 200:
            assert r.near_edited == pytest.approx(len(a & b) / min(len(a), len(b)), abs=0.25)
            assert r.near_edited > 0.4 and r.near_next < 0.1
    assert got[202].fingerprint == got[9].fingerprint


def test_small_texts_keep_their_whole_set(spark):
    row = spark.createDataFrame([("a b c d e f",)], "t string").select(
        F.array_sort(F.array_distinct(shingle_hashes(F.col("t")))).alias("all"), sketch(F.col("t")).alias("kept")).first()
    assert row.all == row.kept and len(row.all) == 6


def test_sketches_merge_and_estimate_containment(spark):
    draw = random.Random(4)
    whole, other = prose(draw, 6000), prose(draw, 50)
    part = " ".join(whole.split(" ")[1000:3000])
    df = spark.createDataFrame([(whole, part, other)], "w string, p string, o string")
    w, p, o = (sketch(F.col(c)) for c in "wpo")
    row = df.select(containment(w, p).alias("part"), containment(w, o).alias("none"), w.alias("w"),
                    merged(sketch(F.lit(" ".join(whole.split(" ")[:3000]))), w).alias("m")).first()
    assert row.part > 0.9 and row.none == 0
    assert set(row.w) <= set(row.m) and len(row.w) >= AT_LEAST


def test_short_texts_inside_a_long_one(spark):
    draw = random.Random(6)
    whole = prose(draw, 5000).split(" ")
    parts = [(n, " ".join(whole[at:at + n])) for n in (20, 50, 100) for at in range(100, 4900, 240)]
    long = sketch(F.lit(" ".join(whole)))
    got = spark.createDataFrame(parts, "n int, t string").select("n", containment(sketch(F.col("t")), long).alias("c")).collect()
    for n in (20, 50, 100):
        found = [r.c for r in got if r.n == n]
        assert sum(c is not None for c in found) >= 0.95 * len(found)
        assert sum(c or 0 for c in found) / len(found) == pytest.approx((n - 4) / n, abs=0.1)


def test_no_hash_to_compare_is_not_nothing_shared(spark, make_docs, as_tables):
    low = spark.createDataFrame([([-(1 << 63) + i for i in range(40)], [5], [-(1 << 63) + 99])], "a array<long>, b array<long>, c array<long>")
    row = low.select(containment(F.col("a"), F.col("b")).alias("none"), containment(F.col("a"), F.col("c")).alias("zero")).first()
    assert row.none is None and row.zero == 0
    draw = random.Random(7)
    whole = prose(draw, 3000)
    docs = [(i, whole if i % 2 else prose(draw, 1), None, None) for i in range(30)] + [(None, "x", None, None)]
    got = op6_fingerprints(spark, as_tables(documents=make_docs(docs))).collect()
    assert {r.next_compared for r in got if r.doc_id is not None} == {True, False}
    assert all(r.near_next == 0 for r in got if not r.next_compared) and not [r for r in got if r.doc_id is None][0].next_compared


def test_empty_null_and_text_form(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n ",)], "t string")
    kept = [r[0] for r in df.select(sketch(F.col("t"))).collect()]
    assert kept == [[], [], []]
    text = spark.createDataFrame([("x",)], "t string").select(as_text(sketch(F.col("t")))).first()[0]
    assert text == text.lower() and int(text, 16) >= 0


def test_rows_without_an_id_and_single_rows(spark, make_docs, as_tables):
    got = op6_fingerprints(spark, as_tables(documents=make_docs([(None, "abcdefgh", None, None), (1, "a b c d", None, None)]))).collect()
    by = {r.doc_id: r for r in got}
    assert by[None].edited_sha256 == hashlib.sha256(b"abcdef").hexdigest() and by[None].near_next == 0
    assert by[1].edited_sha256 == hashlib.sha256(b"a b c a").hexdigest() and by[1].near_next == 1


def test_empty_table(spark, make_docs, as_tables):
    assert op6_fingerprints(spark, as_tables(documents=make_docs([]))).collect() == []
