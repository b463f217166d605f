import tracemalloc
import numpy as np
import pytest
from pyspark.sql import functions as F

from stridemill.llm.language_id import BINS, TextModel, address_parts, declared_language, fit, identify, trigram_counts
from stridemill.llm.language_queries import language_of_pages, op9_language_id

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return fit(documents.filter("doc_id % 2 = 0"), "text", "lang")


def test_held_out_accuracy(spark, documents, model):
    held = documents.filter("doc_id % 2 = 1")
    got = identify(held, "text", model, levels=[F.col("source")]).select("row.lang", "language", "kept").collect()
    assert len(got) == held.count()
    assert sum(r.lang == r.language and r.kept for r in got) >= 0.99 * len(got)


def test_likelihoods_equal_plain_python(documents, model):
    import numpy as np
    row = documents.filter("length(text) > 500").first()
    data = [c if 97 <= c <= 122 or c >= 128 else 32 for c in f" {row.text} ".encode().lower()]
    data = [c for i, c in enumerate(data) if i == 0 or c != 32 or data[i - 1] != 32]
    bins = [((a | b << 8 | c << 16) * 2654435761 % 2 ** 32) >> 18 for a, b, c in zip(data, data[1:], data[2:])]
    scale = 0.5 * min(len(bins), 400) / len(bins)
    ll, n = model.likelihoods(row.text)
    assert n == len(bins)
    for k in range(len(model.languages)):
        assert ll[k] == pytest.approx(scale * sum(model.weights[k][b] for b in bins), rel=1e-9)
    assert ll[-1] == pytest.approx(-scale * len(bins) * np.log(1 << 14))


def test_odd_rows(spark, make_docs, model):
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, " 12 !? ", None, "s"), (None, "the and of with this", None, None),
            (5, "the and of with this " * 20_000, "fr", "s"), (5, "the and of with this " * 20_000, "fr", "s")]
    got = identify(make_docs(rows), "text", model, levels=[F.col("source")])
    have = sorted((str(r.row.doc_id), r.language, r.kept) for r in got.collect())
    assert have == [("1", "und", False), ("2", "und", False), ("3", "und", False), ("5", "en", True), ("5", "en", True), ("None", "en", True)]
    assert identify(make_docs([]), "text", model).collect() == []


def test_strange_texts_are_rejected(make_docs, model):
    import random
    draw = random.Random(1)
    junk = "".join(draw.choice("qxzjkvwy") for _ in range(3000))
    assert [r.kept for r in identify(make_docs([(1, junk, None, None)]), "text", model).collect()] == [False]


def test_codes_in_short_texts_reject_nothing(make_docs, model):
    docs = make_docs([(1, "On the by that to AKQJRTPEYD7FQBC2ZHJX and.", None, None), (2, "of the AKQIART5HK7G62XQ7KS7J with from that", None, None)])
    assert [r.kept for r in identify(docs, "text", model).collect()] == [True, True]


def test_no_labels_reject_nothing(make_docs):
    docs = make_docs([(1, "abc", None, None), (2, None, None, None)])
    got = identify(docs, "text", fit(docs, "text", "lang"))
    assert [(r.language, r.kept) for r in got.collect()] == [(None, True)] * 2


def test_other_evidence_decides_short_texts(spark, documents, model):
    french = [(r.text, "a.fr", "fr") for r in documents.filter("lang = 'fr'").limit(40).collect()]
    english = [(r.text, "b.com", "en") for r in documents.filter("lang = 'en'").limit(40).collect()]
    frame = spark.createDataFrame([*french, *english, ("on", "a.fr", "fr"), ("on", "b.com", "en"), ("on", "new.org", None)],
                                  "text string, host string, said string")
    got = identify(frame, "text", model, F.col("said"), F.element_at(F.split("host", r"\."), -1), [F.col("host")])
    short = {r.row.host: r.language for r in got.collect() if r.row.text == "on"}
    assert short["a.fr"] == "fr" and short["b.com"] == "en" and short["new.org"] in model.languages


def test_rare_labels_are_languages_and_stay(spark, make_docs):
    import random

    from corpus_pipeline import language
    draw = random.Random(3)
    words = "the of and to in that it is was for with on as by at from this which".split()
    rows = [(i, " ".join(draw.choices(words, k=30)), "en", draw.choice("ab")) for i in range(1500)]
    greek = "η γλώσσα των εγγράφων είναι σπάνια αλλά γνωστή και το κείμενο μένει στη συλλογή όπως όλα τα άλλα κείμενα"
    rows += [(5000, greek, "el", "a"), (5001, greek + " εδώ", "el", "b"), (5002, "tyto řádky jsou psány česky a zůstanou také zde", "cs", "a")]
    docs = make_docs(rows)
    model = fit(docs, "text", "lang")
    assert model.languages == ["cs", "el", "en"]
    got = {r.row.doc_id: (r.language, r.kept) for r in identify(docs, "text", model, levels=[F.col("source")]).collect()}
    assert got[5000] == got[5001] == ("el", True) and got[5002] == ("cs", True)
    assert language(spark, docs, None).count() == len(rows)


def test_many_texts_of_a_label_are_sampled(make_docs, monkeypatch):
    from stridemill.llm import language_id
    monkeypatch.setattr(language_id, "LABEL_ROWS", 100)
    docs = make_docs([(i, f"abc{'x' * (i % 40)} def{'y' * (i // 40)}", "en", None) for i in range(1600)] + [(9999, "ab ñandú", "es", None)])
    assert fit(docs, "text", "lang").languages == ["en", "es"]


def test_address_and_declaration(spark):
    df = spark.createDataFrame([("https://u@m.Site.co.example.org:80/a?b#c", '<HTML class=x LANG="pt-BR">'), ("nothing", "<p lang=de>"), (None, None)],
                               "url string, html string")
    rows = df.select(*address_parts(F.col("url")), declared_language(F.col("html"))).collect()
    assert tuple(rows[0]) == ("m.site.co.example.org", "example.org", "org", "pt")
    assert tuple(rows[1]) == (None, None, None, None) and tuple(rows[2]) == (None, None, None, None)


def test_queries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op9_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and sum(r.language == r.lang for r in got) >= 0.97 * len(got)
    pages = language_of_pages(spark, SF).collect()
    assert len(pages) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert sum(r.language == r.declared for r in pages) >= 0.97 * len(pages)


def test_memory_does_not_grow_with_text_and_languages():
    tracemalloc.start()
    model = TextModel([str(k) for k in range(30)], np.log(np.random.default_rng(1).dirichlet(np.ones(BINS), 30)))
    text = "abcdefghij klmnop " * 110_000
    tracemalloc.reset_peak()
    scores, n = model.likelihoods(text)
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()
    bins, _ = trigram_counts(text)
    assert np.allclose(scores[:3], [model.weights[k][bins].sum() * 0.5 * 400 / n for k in range(3)])


def fused(model, rows):
    """The stated rule in plain Python: (language, posterior) of each (text, declared, suffix, host, domain)."""
    from math import exp, log

    from stridemill.llm.language_id import KAPPA, LEAST, STRANGE
    names = model.languages
    found = [model.likelihoods(r[0]) for r in rows]
    tops = [int(np.argmax(ll[:-1])) if n else None for ll, n in found]
    out = []
    for i, row in enumerate(rows):
        others = [(tops[j], rows[j]) for j in range(len(rows)) if j != i and tops[j] is not None]

        def votes(place, value, k=None):
            return sum(1 for top, r in others if r[place] == value and (k is None or top == k))

        logits = []
        for k in range(len(names)):
            mine = sum(top == k for top, _ in others)
            prior = (mine + 1) / (len(others) + len(names))
            for place in (4, 3):
                if row[place] is not None:
                    prior = (votes(place, row[place], k) + KAPPA * prior) / (votes(place, row[place]) + KAPPA)
            logit = found[i][0][k] + log(prior)
            for place in (1, 2):
                if row[place] is not None and votes(place, row[place]):
                    overall = (votes(place, row[place]) + 1) / (len(others) + 1)
                    logit += log((votes(place, row[place], k) + KAPPA * overall) / (mine + KAPPA) / overall)
            logits.append(logit)
        logits.append(found[i][0][-1] + log(STRANGE))
        top = max(logits)
        posterior = 1 / sum(exp(x - top) for x in logits)
        best = logits.index(top)
        known = found[i][1] > 0 and best < len(names) and posterior >= LEAST
        out.append((names[best] if known else "und", posterior if found[i][1] else 0.0))
    return out


def test_posteriors_equal_plain_python(spark, documents, model):
    import random
    draw = random.Random(6)
    texts = [r.text[:k] for r, k in zip(documents.filter("text is not null").limit(60).collect(), [4, 9, 15, 30, 80] * 12)]
    texts += ["", None, "12 34", "on", "la", "qxz kvw"]
    rows = [(text, draw.choice([None, "en", "fr", "xx"]), draw.choice([None, "org", "fr"]), draw.choice([None, "a.org", "b.org"]),
             draw.choice([None, "org"])) for text in texts] + [("of the", "once", "only", "single.only", "single")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                  "at int, t string, said string, suffix string, host string, domain string")
    got = {r.row["at"]: (r.language, r.posterior) for r in identify(
        frame, "t", model, F.col("said"), F.col("suffix"), [F.col("host"), F.col("domain")]).collect()}
    for i, (language, posterior) in enumerate(fused(model, rows)):
        assert got[i][0] == language and abs(got[i][1] - posterior) < 1e-9


def test_a_host_of_one_row_confirms_nothing(spark, documents, model):
    text = "on la zzk"
    others = [(r.text, "big.org", None) for r in documents.limit(30).collect()]
    with_host = spark.createDataFrame([*others, (text, "one.org", "zz")], "t string, host string, said string")
    without = spark.createDataFrame([*others, (text, None, None)], "t string, host string, said string")
    one, other = [[r.posterior for r in identify(f, "t", model, F.col("said"), levels=[F.col("host")]).collect() if r.row.t == text]
                  for f in (with_host, without)]
    assert one == pytest.approx(other, abs=1e-9)


def test_no_rows_and_nulls(spark, model):
    frame = spark.createDataFrame([], "t string, host string")
    assert identify(frame, "t", model, levels=[F.col("host")]).collect() == []
    nulls = spark.createDataFrame([(None, None), (None, None)], "t string, host string")
    assert [(r.language, r.posterior, r.kept) for r in identify(nulls, "t", model, levels=[F.col("host")]).collect()] == [("und", 0.0, False)] * 2


def test_texts_are_not_staged_with_the_scores(spark, make_docs, as_tables, monkeypatch):
    from stridemill.llm import language_id
    staged = {}

    def kept(df, label):
        staged[label] = df.schema.simpleString()
        return stage(df, label)
    stage = language_id.stage
    monkeypatch.setattr(language_id, "stage", kept)
    rows = [(1, "the and of with this", "en", "s"), (2, None, None, None), (None, "le la les et dans", "fr", "s"), (1, "", "en", "s")]
    got = op9_language_id(spark, as_tables(documents=make_docs(rows)))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "1", "2", "None"]
    assert staged["language-scores"].startswith("struct<row:struct<doc_id:bigint>,") and "text" not in staged["language-scores"]


def test_kept_columns_change_no_verdict(spark, documents, model):
    whole = identify(documents, "text", model, levels=[F.col("source")])
    slim = identify(documents, "text", model, levels=[F.col("source")], keep=["doc_id"])
    assert slim.schema["row"].dataType.names == ["doc_id"]
    columns = ["row.doc_id", "language", "posterior", "kept"]
    assert sorted(whole.select(*columns).collect()) == sorted(slim.select(*columns).collect())
