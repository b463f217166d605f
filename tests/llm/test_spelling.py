import random
import re
import zlib
from collections import Counter

import numpy as np

from stridemill.llm import spelling
from stridemill.llm.spelling import Boxes, letters_of, neighbours, variants, word_counts
from stridemill.llm.spelling_queries import dented, op13_spelling_variants

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def edits(word):
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return ({a + b[1:] for a, b in cut if b} | {a + c + b for a, b in cut for c in LETTERS}
            | {a + c + b[1:] for a, b in cut if b for c in LETTERS}) - {word}


def adjacent(one, other):
    """Whether two very long words differ by one edit."""
    one, other = sorted((one, other), key=len)
    head = next((k for k, (a, b) in enumerate(zip(one, other)) if a != b), len(one))
    return one != other and (one[head:] == other[head + 1:] or one[head + 1:] == other[head + 1:])


def brute(counts, least=3, ratio=2):
    known = {w: n for w, n in counts.items() if n >= least}
    near = {w: sorted((-known[v], v) for v in (edits(w) if len(w) < 100 else {v for v in known if len(v) >= 100 and adjacent(w, v)})
                      if v in known) for w in known}
    form = {w: v[0][1] if v and -v[0][0] >= ratio * known[w] else None for w, v in near.items()}
    out = {}
    for w in known:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, known[w], len(near[w]), known[form[w]] if form[w] else None)
    return out


def brute_counts(rows):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 5
    return +counts


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_every_edit(spark, make_docs, as_tables):
    draw = random.Random(13)
    parts = "an ber ch das ein für heit ié ß øre tion un zz".split()
    texts = [" ".join("".join(draw.choices(parts, k=draw.choice([1, 2, 2, 3]))) for _ in range(120)) for _ in range(60)]
    texts += [None, "", "12 345 --", "a" * 70_000 + " " + "a" * 69_999 + "b " + "a" * 69_999, "Wort WORT wörter WÖRTER÷×ab " * 40]
    texts += [texts[-2]] * 4
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(None, texts[0], None, None), (None, texts[0], None, None), (5, texts[5], None, None)]
    got = found(op13_spelling_variants(spark, as_tables(documents=make_docs(rows).repartition(4))))
    want = brute(brute_counts(rows))
    assert got == want and len(want) > 200


def test_supplied_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert found(op13_spelling_variants(spark, folder)) == brute(brute_counts(rows))


def test_many_cells_tiles_and_unseen_lengths(spark, tmp_path, monkeypatch):
    draw = random.Random(14)
    words = {"".join(draw.choices("abcdé", k=draw.choice([5, 6, 7, 8]))) for _ in range(4000)}
    words |= {"".join(draw.sample("abcdefgh", 8)) for _ in range(300)} | {"q" * k for k in (20, 21, 23)} | {"ab" * 30 + "x" * k for k in (0, 1)}
    counts = {w: draw.choice([3, 3, 4, 7, 15, 40, 200]) for w in words}
    # Few sampled words and small cells: anagrams can't be split, some lengths have no tree.
    monkeypatch.setattr(spelling, "SAMPLE", 900)
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    assert found(variants(frame, cell=40)) == brute(counts)


def test_chains_ties_and_empty(spark):
    counts = {"spelling": 3, "speling": 6, "spelng": 12, "spelngs": 24, "other": 5, "othes": 10, "othex": 10, "alone": 2}
    got = found(variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts) and got["spelling"][:2] == ("speling", "spelngs") and got["other"][0] == "othes"
    assert variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_boxes_prune_without_loss():
    draw = random.Random(15)
    words = sorted({"".join(draw.choices("aabcdeé", k=7)) for _ in range(3000)})
    tree = Boxes(letters_of(words))
    for length in (6, 7):
        asked = sorted({"".join(draw.choices("aabcdeéz", k=length)) for _ in range(400)})
        i, j = tree.near(letters_of(asked))
        assert {(asked[a], words[b]) for a, b in zip(i, j)} == {(a, b) for a in asked for b in edits(a) & set(words) if len(b) == 7}


def test_counts_of_changed_words(spark, make_docs):
    rows = [(i, "Maßstab maßstab MASSSTAB x abcdef" * 3, None, None) for i in range(400)] + [(None, None, None, None)]
    got = {r.word: r.n for r in word_counts(make_docs(rows), "doc_id", "text", 5, dented).collect()}
    assert got == brute_counts(rows) and len(got) > 5
    assert np.sum(list(word_counts(make_docs([]), "doc_id", "text").toPandas()["n"])) == 0
