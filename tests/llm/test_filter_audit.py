import random
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stridemill.llm.audit_queries import op11_filter_audit
from stridemill.llm.filter_audit import number_of, row_totals, term_shards

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """Every count by walking all documents through all orders."""
    facts = []
    for i, text, lang, _ in rows:
        t = text or ""
        w = t.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t),
                 "E": any(j is not None and (i is None or j < i) and (u or "") == t for j, u, _, _ in rows)}
        mine = [(q, x) for j, q, x in labels if j is not None and j == i]
        facts.append((lang or "", {k for k, v in fails.items() if v}, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    out, removed = {}, Counter()
    for part in {f[0] for f in facts}:
        for order in permutations("ABCDE"):
            for step in range(1, 6):
                own, before = order[step - 1], set(order[:step - 1])
                here = [f for f in facts if f[0] == part]
                left = [f for f in here if not f[1] & before]
                gone = [f for f in left if own in f[1]]
                out[part, "".join(order), step] = [
                    len(left) - len(gone), len(gone), sum(own in f[1] for f in here) - len(gone),
                    sum(f[1] == {own} for f in here), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                removed[part, own] += len(gone)
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost,
                                              r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_all_orders_against_a_walk(spark, make_docs, as_tables):
    draw = random.Random(11)
    bag = ["word%d" % i for i in range(400)] + ["THE", "$5", "é", "a|b", "Ab"]
    texts = [" ".join(draw.choices(bag[:draw.choice([3, 40, 400, 405])], k=draw.choice([0, 1, 150, 199, 200, 450]))) for _ in range(60)]
    texts += [None, "", " \t\n", "x" * 300_000, "AA BB\x0bcc", "same", "same", "same"]
    rows = [(i, t, draw.choice(["en", "de", None, ""]), None) for i, t in enumerate(texts)]
    rows += [(None, "same", "en", None), (None, "only here", "en", None), (None, "only here", "xx", None), (3, "same", "en", None),
             (2, None, "de", None), (3, "same", "en", None)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(40)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    folder = as_tables(documents=make_docs(rows).repartition(5), labels=spark.createDataFrame(labels, LABELS))
    assert found(op11_filter_audit(spark, folder)) == brute(rows, labels)


def test_no_documents_and_no_labels(spark, make_docs, as_tables):
    folder = as_tables(documents=make_docs([]), labels=spark.createDataFrame([], LABELS))
    assert op11_filter_audit(spark, folder).collect() == []


@pytest.mark.parametrize("number", [number_of, len, lambda word: 7], ids=["hash", "length", "one"])
def test_matrix_holds_every_count(spark, make_docs, number):
    """Also where many words, or all, have the same hash."""
    draw = random.Random(12)
    texts = [" ".join(draw.choices("a b c dd ee A é zz".split(), k=draw.randrange(0, 30))) for _ in range(200)] + [None, "", "q " * 5000]
    shards, dictionary = term_shards(make_docs([(i, t, None, None) for i, t in enumerate(texts)]).repartition(3), "text", 300, number)
    word = {r.term: bytes(r.word).decode() for r in dictionary.collect()}
    assert len(word) == len(set(word.values())) == len(set(" ".join(t or "" for t in texts).split()))
    seen, parts = {}, shards.collect()
    assert len(parts) > 10
    for s in parts:
        indptr, terms = np.frombuffer(s.indptr, np.int64), np.frombuffer(s.terms, np.int64)
        counts = np.frombuffer(s.counts, np.int32)
        for k, r in enumerate(s.rows):
            at = slice(indptr[k], indptr[k + 1])
            seen[r.doc_id] = {word[t]: int(c) for t, c in zip(terms[at], counts[at])}
    assert seen == {i: dict(Counter((t or "").split())) for i, t in enumerate(texts)}
    totals = {r.doc_id: (r.n_words, r.n_distinct) for r in row_totals(shards).select("row.*", "n_words", "n_distinct").collect()}
    assert totals == {i: (len((t or "").split()), len(set((t or "").split()))) for i, t in enumerate(texts)}


def test_shapley_counts_the_removed_rows_once_per_order(spark, as_tables):
    folder = "/root/testdata/sf0.001"
    got = op11_filter_audit(spark, folder)
    per = got.groupBy("part", "filter_order").agg(F.sum("removed").alias("gone"), F.min("kept").alias("left"))
    sizes = {r.lang or "": r.n for r in spark.read.parquet(f"{folder}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert all(r.gone + r.left == sizes[r.part] for r in per.collect())


def seen_by_python(frame):
    """(rows, bytes) of every batch that a Python task gets of ``frame``."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])
    return [(r.n, r.size) for r in frame.mapInArrow(run, "n long, size long").collect()]


def test_python_gets_shards_one_by_one_and_few_texts(spark, make_docs):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    long = [" ".join(map(str, range(k, k + 200_000))) for k in range(6)]
    docs = make_docs([(i, t, None, None) for i, t in enumerate(long)] + [(i, "ab " * 30_000, None, None) for i in range(6, 60)]).coalesce(1)
    try:
        shards, _ = term_shards(docs.select("doc_id", "text"), "text", 1 << 20)
        batches = seen_by_python(shards)
        assert sum(n for n, _ in batches) == shards.count() >= 7 and all(n == 1 for n, size in batches if size > 2 << 20)
        assert all(n == 1 or size <= 1.3 * (1 << 20) for n, size in seen_by_python(docs.select("doc_id", "text")))
        for lower in ("64k", "1000"):
            spark.conf.set(key, lower)
            term_shards(docs.limit(0), "text")
            assert spark.conf.get(key).rstrip("b") in (lower, "65536")
    finally:
        spark.conf.set(key, before)
