import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from stridemill.llm import near_duplicates as near_duplicates_module
from stridemill.llm.components import components
from stridemill.llm.dedup_queries import op1_near_dedup
from stridemill.llm.near_duplicates import HASHES, STEP, least_matches, near_duplicates, signature, survivors
from stridemill.llm.shingles import common, shingle_set, word_hashes


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k=4, percent=80):
    """Smallest id of every id's component, links found by comparing everything."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for (i, a), (j, b) in combinations([s for s in sets if s[0] is not None], 2):
        both = len(a & b)
        if a and b and 100 * both >= percent * (len(a) + len(b) - both):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in parent}, {i: len(s) for i, s in sets}


def family(draw, size, edits):
    base = ["".join(draw.choice("abcdefg") for _ in range(4)) for _ in range(150)]
    copies = []
    for _ in range(size):
        words = list(base)
        for _ in range(draw.choice(edits)):
            words[draw.randrange(len(words))] = str(draw.random())
        copies.append(" ".join(words))
    return copies


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_all_pairs(spark, make_docs, as_tables, seed):
    draw = random.Random(seed)
    texts = family(draw, 40, [0, 1, 2, 4, 6, 9]) + family(draw, 12, [0, 3]) + family(draw, 6, [7])
    texts += [None, "", " \n ", "One two", "one TWO", "one two three", "ONE two\tthree", "x", "É a", "é a"]
    texts += [" ".join(draw.choices("abc", k=40)) for _ in range(25)] + ["long text " * 8000, "long text " * 8001]
    draw.shuffle(texts)
    ids = draw.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    got = op1_near_dedup(spark, as_tables(documents=make_docs([(i, t, None, None) for i, t in rows]).repartition(5))).collect()
    parts, sizes = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.n_shingles, r.kept) == (parts[r.doc_id], sizes[r.doc_id], parts[r.doc_id] == r.doc_id)


def test_rows_without_an_id_and_repeated_ids(spark, make_docs, as_tables):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, "p q r s"), (3, "p q r s"), (9, None)]
    got = op1_near_dedup(spark, as_tables(documents=make_docs([(i, t, None, None) for i, t in rows]))).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("2", "2", True), ("3", "2", False), ("3", "2", False), ("3", "2", False), ("9", "9", True), ("None", "None", True)]


def test_blocks_of_a_large_bucket_meet(spark, make_docs, monkeypatch):
    from stridemill.llm import near_duplicates as module
    monkeypatch.setattr(module, "BLOCK", 4)
    draw = random.Random(8)
    # Copies of copies: few of them are close to any one text.
    words, texts = ["w%d" % i for i in range(120)], []
    for step in range(30):
        words[draw.randrange(120)] = f"s{step}"
        texts.append(" ".join(words))
    draw.shuffle(texts)
    docs = make_docs([(i, t, None, None) for i, t in enumerate(texts)])
    got = {r.id: r.component for r in near_duplicates(docs, "doc_id", "text", width=4).collect()}
    assert got == brute(list(enumerate(texts)))[0]


def test_two_of_three_are_compared_where_the_lead_is_just_below(spark, make_docs):
    """B and C are alike by 134/166, both to A by 133/167, and share buckets with A alone."""
    texts = []
    for seed in (527, 573, 1136, 1372, 1373, 2183, 2258, 2542, 2570, 2624, 2976, 3018):
        draw = np.random.default_rng(seed)
        base = [f"w{x}" for x in draw.integers(0, 10 ** 9, 153)]
        for changed in ([10, 18], [30, 38], [60, 70, 71]):
            words = list(base)
            for k in changed:
                words[k] = f"x{draw.integers(0, 10 ** 9)}"
            texts.append(" ".join(words))
    docs = make_docs([(i, t, None, None) for i, t in enumerate(texts)])
    got = {r.id: r.component for r in near_duplicates(docs, "doc_id", "text", width=4).collect()}
    assert got == brute(list(enumerate(texts)))[0] == {i: i - (i % 3 == 1) for i in range(len(texts))}


def test_empty_table(spark, make_docs, as_tables):
    assert op1_near_dedup(spark, as_tables(documents=make_docs([]))).collect() == []


def test_shingles_are_exact():
    text = "The cat sat  on\tthe\x0bMAT \x85 the cat sat on the mat"
    assert len(shingle_set(text, 3)) == len(shingles(text, 3)) and len(word_hashes(text)) == len(text.encode().split())
    a, b = shingle_set("a b c d e f g", 3), shingle_set("x b c d e f y", 3)
    assert common(a, b) == 3 and len(shingle_set("", 3)) == 0 and common(a, shingle_set("", 3)) == 0


def test_posterior_bounds_lose_few_and_drop_many():
    need = least_matches(0.8, 2e-3)
    assert len(need) == HASHES // STEP and (np.diff(need) >= 0).all()
    draw = np.random.default_rng(0)

    def kept(similarity):
        one = draw.integers(0, 256, (4000, HASHES), dtype=np.uint8)
        other = np.where(draw.random(one.shape) < similarity, one, one + 1).astype(np.uint8)
        return len(survivors(one, other, need)) / 4000
    assert kept(0.8) > 0.985 and kept(0.9) > 0.999 and kept(0.65) < 0.01 and kept(0.3) == 0


def test_default_bounds_lose_few_pairs_at_the_threshold():
    import inspect
    need = least_matches(0.8, inspect.signature(near_duplicates).parameters["miss"].default)
    draw = np.random.default_rng(0)
    one = draw.integers(0, 256, (20_000, HASHES), dtype=np.uint8)
    other = np.where(draw.random(one.shape) < 0.8, one, one + 1).astype(np.uint8)
    assert len(survivors(one, other, need)) >= 0.997 * 20_000


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    a = np.unique(draw.integers(0, 1 << 63, 1000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:800], draw.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    assert abs((signature(a) == signature(b)).mean() - 800 / 1200) < 0.12


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 40)]
    got = components(spark.createDataFrame(chain + star + [(5000, 4000)], "a long, b long")).collect()
    assert {r.root for r in got} == {0, 1000, 4000} and len(got) == 61 + 40 + 2
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def near_threshold(draw, size, edits):
    """Copies of one text of 1003 words with ``edits`` far-apart words replaced: 14 give pairs of similarity 0.799, 13 of 0.812."""
    base = [f"w{k}" for k in range(1003)]
    copies = []
    for _ in range(size):
        words = list(base)
        for k in draw.sample(range(1, 200), draw.choice(edits)):
            words[5 * k] = str(draw.random())
        copies.append(" ".join(words))
    return copies


@pytest.mark.parametrize("edits", [[14], [13, 14]])
def test_near_threshold_groups_leave_a_cell_as_spanning_links(edits):
    sets = [shingle_set(t, 4) for t in near_threshold(random.Random(7), 400, edits)]
    n = len(sets)
    sig = [signature(s).tobytes() for s in sets]
    ones = np.zeros(n, np.int64)
    table = pa.table({"key": ones, "band": ones.astype(np.int32), "lo": ones, "hi": ones, "mine": ones, "rep": np.arange(n),
                      "root": np.arange(n), "sig": sig, "members": [s.tobytes() for s in sets]})
    least = least_matches(0.8, 2e-4)
    everything = [(i, j) for part in near_duplicates_module._likely(table, near_duplicates_module._bytes(table.column("sig"), HASHES), least)
                  for i, j in zip(*part)]
    out = near_duplicates_module._in_cells(iter(table.to_batches()), least, lambda *cell: near_duplicates_module._spanning(*cell, 80))
    links = [(a, b) for batch in out for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist())]
    assert len(links) < n < len(everything)

    def joined(pairs):
        up = list(range(n))
        for a, b in pairs:
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        out = []
        for a in range(n):
            while up[a] != a:
                a = up[a]
            out.append(a)
        return out
    alike = [(i, j) for i, j in everything if 100 * common(sets[i], sets[j]) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert joined(links) == joined(alike)


def test_near_threshold_group_through_the_operator(spark, make_docs):
    draw = random.Random(8)
    texts = near_threshold(draw, 40, [14]) + near_threshold(draw, 25, [10, 13, 14, 15])
    rows = list(enumerate(texts))
    got = near_duplicates(make_docs([(i, t, None, None) for i, t in rows]), "doc_id", "text", width=4).collect()
    assert {r.id: r.component for r in got} == brute(rows)[0]
