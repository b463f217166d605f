import hashlib
import random
import re

import numpy as np

from stridemill.llm.secret_queries import op12_secret_scan
from stridemill.llm.secrets import ENCODINGS, Ordinary, base_spans, battery, encoding_of, scan, thresholds

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    """The fixed kinds by the patterns as they are written, cases spelled out."""
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in re.finditer(ASSIGN, text) if len(m[1]) >= 8]
    access = [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    run = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    rank = {"assign": 0, "access": 1, "hex": 2}
    listed = sorted(spans + access + run, key=lambda s: (s[1], rank[s[0]]))
    line = ",".join(f"{k}:{s}:{e}" for k, s, e in listed)
    return len(spans), len(access), len(run), hashlib.sha256(line.encode()).hexdigest(), line


def random_string(draw, alphabet, n):
    return "".join(draw.choice(alphabet) for _ in range(n))


def prose(draw, words=150):
    bag = "the quick information of considerable understanding was given to several departments by Internationalisierung and others".split()
    return " ".join(draw.choice(bag) for _ in range(words))


def test_base_kinds_against_the_written_patterns(spark, make_docs, as_tables):
    draw = random.Random(12)
    bits = ["password", "PassWd", "secret", "token", "apikey", "API_KEY", "toſen", "toKen", "\"", "'", " ", "  ", ":", "=", "==", "abc", "12345678",
            "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "é", "\t", ".", "-", "token=abc.def-ghi", "\n", "x" * 9, "F", "f"]
    texts = ["".join(draw.choices(bits, k=draw.choice([3, 10, 60]))) for _ in range(400)]
    texts += [None, "", "secret=token:abcdefghij", "password=éabcdefgh", "AKIAAKIAAKIAAKIA0", "é" * 50_000 + "token: 'abcdefgh1'",
              "a" * 100_000, "password:" * 1000]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "token=12345678", None, None), (1, "token=12345678", None, None)]
    got = op12_secret_scan(spark, as_tables(documents=make_docs(rows).repartition(3))).collect()
    have = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got)
    want = {(str(i), *brute(t)[:4]): brute(t)[4] for i, t, _, _ in rows}
    assert have == sorted((str(i), *brute(t)[:4]) for i, t, _, _ in rows)
    for r in got:
        base = want[str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256]
        kept = [s for s in r.spans.split(",") if s and not s.startswith("random-")]
        assert ",".join(kept) == base and len(r.spans.split(",")) - (not r.spans) == len(kept) + r.n_random


def test_random_tokens_are_found_and_text_is_not(spark, make_docs, as_tables):
    draw = random.Random(16)
    rows, planted = [], {}
    for i in range(600):
        text = prose(draw)
        if i % 4 == 0:
            name = draw.choice(["base64", "base62", "base64url", "hex", "BASE36"])
            planted[i] = random_string(draw, ENCODINGS[name], draw.choice([30, 31] if name == "hex" else [32, 40, 64]))
            text = f"{text} {planted[i]} {prose(draw, 20)}"
        elif i % 4 == 1:
            text += " Donaudampfschifffahrtsgesellschaft some-quite-long-hyphenated-name-of-things 4111111111111111 /usr/local/share/applications " \
                    "abcdefghijklmnopqrstuvwxyz 0000000000000000000a getInternationalDepartmentName"
        rows.append((i, text, None, None))
    got = op12_secret_scan(spark, as_tables(documents=make_docs(rows).repartition(4))).collect()
    texts = {i: t for i, t, _, _ in rows}
    hits, false = 0, 0
    for r in got:
        for span in filter(None, r.spans.split(",")):
            _, start, end = span.split(":")
            good = texts[r.doc_id][int(start):int(end)] == planted.get(r.doc_id)
            hits, false = hits + good, false + (not good)
    assert hits >= 0.9 * len(planted) and false <= 0.08 * hits


def test_one_document_and_none(spark, make_docs, as_tables, tmp_path):
    draw = random.Random(17)
    key = random_string(draw, ENCODINGS["base64"], 48)
    frame = make_docs([(1, f"{prose(draw, 300)} {key}", None, None)])
    r = op12_secret_scan(spark, as_tables(documents=frame)).collect()[0]
    start = r.spans.split(":")[1]
    assert r.n_random == 1 and frame.collect()[0].text[int(start):] == key
    make_docs([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op12_secret_scan(spark, f"{tmp_path}/none").collect() == []


def test_battery_is_even_on_noise_and_small_on_text():
    draw = np.random.default_rng(18)
    for size, n in ((16, 32), (64, 40), (62, 200)):
        p = battery(draw.integers(0, size, (3000, n)).astype(np.uint8), size)
        assert 0.45 < p.mean() < 0.58 and (p < 0.05).mean() < 0.1
        long = battery(draw.integers(0, size, (1, 700_000)).astype(np.uint8), size)
        assert 0 <= long[0] <= 1
        counting = np.tile(np.arange(size), n)[None, :n * 3].astype(np.uint8)
        assert battery(counting, size)[0] < 0.01
    codes = {c: i for i, c in enumerate(ENCODINGS["base64"])}
    text = np.array([[codes[c] for c in "thisisquiteordinarytextwithoutanyblanksinit"]], np.uint8)
    assert battery(text, 64)[0] < 0.01


def test_thresholds_equal_the_step_up_rule(spark, make_docs):
    """Benjamini and Hochberg on the same p-values in plain Python."""
    draw = random.Random(19)
    rows = [(i, f"{prose(draw, 60)} {random_string(draw, ENCODINGS['base62'], 36)} Xinternationalisierungsfragen"
             * draw.choice([1, 2]), None, None) for i in range(150)]
    scanned = scan(make_docs(rows), "text")
    tokens, decoys = {}, {}
    for r in scanned.collect():
        for t in r.seen:
            tokens.setdefault((t.encoding, t.band), []).append(t.bin)
            decoys.setdefault((t.encoding, t.band), []).extend(t.decoys)
    for rate in (0.05, 0.3):
        want = {}
        for key, bins in tokens.items():
            p = {b: (1 + sum(d >= b for d in decoys[key])) / (1 + len(decoys[key])) for b in {*bins, *decoys[key]}}
            passing = [b for b in p if sum(t >= b for t in bins) and p[b] * len(bins) <= rate * sum(t >= b for t in bins)]
            if passing:
                want[key] = min(passing)
        assert {(r.encoding, r.band): r.least for r in thresholds(scanned, rate).collect()} == want and want


def test_encodings_and_windows():
    assert [encoding_of(x) for x in ("0123", "12ab", "12AB", "GHKZ2", "wxyz1", "WXYZ1", "aB1", "aB/", "aB_", "a/_")] == \
        [None, "hex", "HEX", "base32", "base36", "BASE36", "base62", "base64", "base64url", None]
    text = "éab cde XYZXYZ fgh ij"
    start = text.index("XYZ")
    for name in ("base36", "base62"):
        plain = [ENCODINGS[name].index(c) for c in "abcdefghij"]
        got = [w.tolist() for w in Ordinary(text).windows(name, start, start + 6)]
        assert got == [plain[k:k + 6] for k in range(5)]
    assert base_spans("") == []
