"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests tells from text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import erfc, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The kinds in their order, with the least length of what is measured.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")       # runs are maximal, so shorter ones are those that fail
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_VALUE, LEAST_ACCESS = 8, 16

# Encodings from narrow to wide: a token's is the first whose alphabet has all its symbols.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = {
    "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": UPPER + "234567",
    "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
}
CODES = {name: np.full(256, 255, np.uint8) for name in ENCODINGS}
FOLDED = {name: np.full(256, 255, np.uint8) for name in ENCODINGS}    # the same; one-case alphabets take both cases
for _name, _alphabet in ENCODINGS.items():
    for _way in (_alphabet.swapcase(), _alphabet):
        FOLDED[_name][np.frombuffer(_way.encode(), np.uint8)] = np.arange(len(_alphabet))
    CODES[_name][np.frombuffer(_alphabet.encode(), np.uint8)] = np.arange(len(_alphabet))
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
DECOYS, BINS, BLOCK = 20, 100, 1 << 18
SEEN = "start:int,end:int,encoding:string,band:int,bin:int,decoys:array<int>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    spans = []
    data = text.encode("utf-8", "surrogatepass").lower()
    if any(k in data for k in KEYWORDS):
        # A match whose value is too short still takes its text, so lengths are looked at afterwards.
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return spans + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def encoding_of(token: str) -> str | None:
    """The narrowest encoding of a token with letters; None for numbers."""
    symbols = set(token)
    if symbols <= set(DIGITS):
        return None
    return next((name for name, alphabet in ENCODINGS.items() if symbols <= set(alphabet)), None)


def band_of(length: int) -> int:
    """Length band: four for every doubling."""
    return int(4 * log(length, 2))


def _two_sided(z: np.ndarray) -> np.ndarray:
    return np.array([erfc(abs(v) / sqrt(2)) for v in z])


def battery(windows: np.ndarray, size: int) -> np.ndarray:
    """One p-value for each row of ``windows`` (codes below ``size``): is it even random noise?

    Three tests, joined by Fisher's rule.  Symbol counts against an even alphabet by
    chi-squared, with the variance of short strings; runs below and above the alphabet's middle
    (Wald-Wolfowitz); correlation of neighbouring codes.  All are two-sided: counting upwards
    is no noise either.  Everything comes from the counts of neighbouring pairs, so memory
    doesn't grow with the length.
    """
    rows, n = windows.shape
    pairs = np.zeros((rows, size * size), np.int64)
    shift = (np.arange(rows) * size * size)[:, None]
    for at in range(0, n - 1, BLOCK):
        part = windows[:, at:at + BLOCK + 1].astype(np.int64)
        pairs += np.bincount((part[:, :-1] * size + part[:, 1:] + shift).ravel(), minlength=pairs.size).reshape(pairs.shape)
    pairs = pairs.reshape(rows, size, size)
    counts = pairs.sum(axis=2)
    counts[np.arange(rows), windows[:, -1]] += 1
    code = np.arange(size)

    # Wilson and Hilferty's cube root of a gamma with chi-squared's mean and, at n symbols, variance.
    chi = (counts.astype(float) ** 2).sum(axis=1) * size / n - n
    mean, variance = size - 1.0, 2 * (size - 1.0) * (n - 1) / n
    degrees = 2 * mean ** 2 / variance
    uneven = (np.cbrt(np.maximum(chi, 0) / mean) - (1 - 2 / (9 * degrees))) / sqrt(2 / (9 * degrees))

    high = code >= size // 2
    above = counts[:, high].sum(axis=1).astype(float)
    below = n - above
    changes = pairs[:, high][:, :, ~high].sum(axis=(1, 2)) + pairs[:, ~high][:, :, high].sum(axis=(1, 2))
    expected = 2 * above * below / n + 1
    spread = np.sqrt(np.maximum((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    runs = np.where((above == 0) | (below == 0), -sqrt(n), (changes + 1 - expected) / spread)

    average = counts @ code / n
    square = counts @ (code.astype(float) ** 2) - n * average ** 2
    edges = average * (windows[:, 0].astype(float) + windows[:, -1])
    cross = (pairs * np.outer(code, code)).sum(axis=(1, 2)) - 2 * n * average ** 2 + edges + (n - 1) * average ** 2
    serial = np.where(square > 0, (cross / np.maximum(square, 1e-9) + 1 / n) * sqrt(n), sqrt(n))

    fisher = -2 * sum(np.log(np.maximum(_two_sided(z), 1e-300)) for z in (uneven, runs, serial)) / 2
    return np.exp(-fisher) * (1 + fisher + fisher ** 2 / 2)    # chi-squared of six degrees


class Ordinary:
    """Windows of ordinary text as codes of an encoding, to tell how often text looks random.

    All symbols of the alphabet in the text outside the token, in order and letters in the
    alphabet's case, are one string; up to 20 windows lie evenly over it.
    """

    def __init__(self, text: str) -> None:
        self.points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.of: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def windows(self, encoding: str, start: int, end: int) -> Iterator[np.ndarray]:
        if encoding not in self.of:
            codes = FOLDED[encoding][np.minimum(self.points, 255)]
            places = np.flatnonzero(codes != 255)
            self.of[encoding] = codes[places], places
        codes, places = self.of[encoding]
        begin, length = int(np.searchsorted(places, start)), end - start
        room = len(codes) - 2 * length
        if room >= 0:
            for at in sorted({room * k // (DECOYS - 1) for k in range(DECOYS)}):
                before = codes[at:min(at + length, begin)]
                yield before if len(before) == length else np.concatenate(
                    [before, codes[max(at, begin) + length:at + 2 * length]])


def tokens_of(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Tokens outside the base spans with an encoding, their score and their decoys' scores (as bins)."""
    found, ordinary = [], None
    blocked = sorted((start, end) for _, start, end in spans)
    k = 0
    for m in TOKEN.finditer(text):
        while k < len(blocked) and blocked[k][1] <= m.start():
            k += 1
        if k < len(blocked) and blocked[k][0] < m.end():
            continue
        encoding = encoding_of(m[0])
        if encoding is None:
            continue
        ordinary = ordinary or Ordinary(text)
        own = CODES[encoding][np.frombuffer(m[0].encode(), np.uint8)]
        windows = [own, *ordinary.windows(encoding, *m.span())]
        size = len(ENCODINGS[encoding])
        if len(own) * len(windows) <= BLOCK:
            p = battery(np.stack(windows), size)
        else:
            p = np.concatenate([battery(w[None], size) for w in windows])
        bins = np.minimum((p * BINS).astype(int), BINS - 1).tolist()
        found.append({"start": m.start(), "end": m.end(), "encoding": encoding, "band": band_of(len(own)),
                      "bin": bins[0], "decoys": bins[1:]})
    return found


def scan(frame: DataFrame, text: str) -> DataFrame:
    """(row, base, seen): every row's base spans, and the tokens tested with their scores.

    Whole texts; null is empty.  ``base`` is an array of (kind, start, end), ``seen`` of tokens
    in no base span; places are code points, ends exclusive.
    """
    slim = frame.select(F.struct(*[frame[f"`{c}`"] for c in frame.columns if c != text]).alias("row"),
                        frame[f"`{text}`"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        token = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("band", pa.int32()),
                                    ("bin", pa.int32()), ("decoys", pa.list_(pa.int32()))]))
        for batch in batches:
            base, seen = [], []
            texts = batch.column("_text")
            for i in range(batch.num_rows):
                here = texts[i].as_py() or ""
                spans = base_spans(here)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                seen.append(tokens_of(here, spans))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(base, span), pa.array(seen, token)],
                                             ["row", "base", "seen"])
    return slim.mapInArrow(run, f"row {slim.schema['row'].dataType.simpleString()}, "
                                f"base array<struct<kind:string,start:int,end:int>>, seen array<struct<{SEEN}>>")


def thresholds(scanned: DataFrame, rate: float) -> DataFrame:
    """(encoding, band, least): the score from which tokens of an encoding and length are secrets.

    All tokens of the table with one encoding and length band are tested together.  A token's
    p-value is the share of the band's decoys, itself counted as one, that look at least as
    random; Benjamini and Hochberg's rule then bounds the expected share of ordinary text among
    the reports by ``rate``.  Short tokens, where text passes for noise, thus need more than
    long ones or are never reported.  Scores are counted in bins, so what is gathered here is
    at most encodings x bands x bins, whatever the table's size.  Bands without a threshold
    have no row.
    """
    tokens = scanned.select(F.explode("seen").alias("t")).select("t.encoding", "t.band", "t.bin", "t.decoys")
    marked = tokens.select("encoding", "band", F.explode(F.concat(
        F.array(F.struct("bin", F.lit(True).alias("token"))),
        F.transform("decoys", lambda d: F.struct(d.alias("bin"), F.lit(False).alias("token"))))).alias("m"))
    counts = marked.groupBy("encoding", "band", F.col("m.bin").alias("bin")).agg(
        F.count(F.when(F.col("m.token"), 1)).alias("_tokens"), F.count(F.when(~F.col("m.token"), 1)).alias("_decoys"))
    group = Window.partitionBy("encoding", "band")
    upward = group.orderBy(F.desc("bin"))
    p = (1 + F.sum("_decoys").over(upward)) / (1 + F.sum("_decoys").over(group))
    enough = p * F.sum("_tokens").over(group) <= rate * F.sum("_tokens").over(upward)
    return (counts.select("encoding", "band", "bin", enough.alias("_go")).filter("_go")
            .groupBy("encoding", "band").agg(F.min("bin").alias("least")))


def with_random(scanned: DataFrame, rate: float = 0.05) -> DataFrame:
    """``scanned``, which is staged, with ``random``: its tokens reported at the false-discovery ``rate``.

    The thresholds, one small number for each encoding and length band, are read on the driver
    and written into the expression.
    """
    rows = thresholds(scanned, rate).collect()
    if not rows:
        return scanned.withColumn("random", F.filter("seen", lambda t: F.lit(False)))
    cut = F.create_map(*[F.lit(x) for r in rows for x in (f"{r.encoding}:{r.band}", r.least)])
    key = lambda t: F.concat_ws(":", t["encoding"], t["band"].cast("string"))
    return scanned.withColumn("random", F.filter("seen", lambda t: F.coalesce(
        t["bin"] >= F.try_element_at(cut, key(t)), F.lit(False))))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, then other kinds by name."""
    def rank(kind: Column) -> Column:
        at = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
        return F.when(at == 0, F.lit(len(KINDS) + 1)).otherwise(at)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
