"""Language identification by Bayesian evidence fusion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, stage, text_batches

BINS = 1 << 14          # hashed byte trigrams
LABEL_ROWS = 4_000      # texts of each label that fit the text model, about; all of a label with fewer
REACH, TRUST = 400, 0.5  # trigrams follow each other: so many count at most, each that much
NOISE = 0.1             # share of trigrams a text of any language may owe to codes, names and the like
STRANGE = 0.01          # prior of a text in no known language
KAPPA = 10.0            # rows that the level above counts for in a smoothed prior
LEAST = 0.5             # posterior a language needs
UNKNOWN = "und"


def trigram_counts(text: str) -> tuple[np.ndarray, int]:
    """Counts of hashed trigrams of the text's lower-cased bytes and their number.

    Digits, marks and blanks are one symbol, so that markup and figures say little.
    """
    data = np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass").lower(), np.uint8).astype(np.uint32)
    data = np.where(((data >= 97) & (data <= 122)) | (data >= 128), data, 32)
    data = data[np.append(True, (data[1:] != 32) | (data[:-1] != 32))]
    if len(data) < 3 or not (data != 32).any():
        return np.zeros(0, np.int64), 0
    grams = (data[:-2] | (data[1:-1] << np.uint32(8)) | (data[2:] << np.uint32(16))) * np.uint32(2654435761)
    return (grams >> np.uint32(32 - 14)).astype(np.int64), len(grams)


@dataclass
class TextModel:
    languages: list[str]
    weights: np.ndarray      # (languages, BINS) log probabilities

    def likelihoods(self, text: str | None) -> tuple[list[float], int]:
        """Log likelihood of the text in each language and, last, in none; and its trigrams."""
        bins, n = trigram_counts(text or "")
        if not n:
            return [0.0] * (len(self.languages) + 1), 0
        scale = TRUST * min(n, REACH) / n
        return [*(self.weights @ np.bincount(bins, minlength=BINS) * scale).tolist(), -np.log(BINS) * scale * n], n


def fit(labelled: DataFrame, text: str, label: str, seed: int = 3) -> TextModel:
    """Trigram model of every language among the labelled rows.

    Fitted on about ``LABEL_ROWS`` distinct texts of each label, those whose seeded hash is
    lowest, and on all of a label with fewer: every label with a text that has letters is a
    language, however rare.  What comes to the driver is one count for each language and bin.
    Without labelled rows it knows no language.
    """
    text_batches(labelled.sparkSession)
    rows = (labelled.select(labelled[f"`{text}`"].alias("_text"), labelled[f"`{label}`"].cast("string").alias("_label"))
            .filter("_text is not null and _label is not null").withColumn("_hash", F.xxhash64(F.lit(seed), "_text")))
    # Each label's share of the hash range; nothing is sorted, and texts are read where they lie.
    share = LABEL_ROWS / F.col("_n")
    last = stage(rows.groupBy("_label").agg(F.approx_count_distinct("_hash").alias("_n")).select(
        "_label", F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise(
            (F.lit(-2.0 ** 63) + F.lit(2.0 ** 64) * share).cast("long")).alias("_last")), "language-labels")
    some = (join_small(rows, last, ["_label"]).filter(F.col("_hash") <= F.col("_last"))
            .groupBy("_hash", "_label").agg(F.min("_text").alias("_text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text_, label_ in zip(batch.column("_text").to_pylist(), batch.column("_label").to_pylist()):
                mine = sums.setdefault(label_, np.zeros(BINS, np.int64))
                mine += np.bincount(trigram_counts(text_)[0], minlength=BINS)
        for label_, mine in sums.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([label_] * len(at), pa.string()), pa.array(at), pa.array(mine[at])],
                                             ["label", "bin", "n"])

    counts = some.mapInArrow(count, "label string, bin long, n long").groupBy("label", "bin").agg(F.sum("n").alias("n"))
    table = counts.toArrow().to_pydict()
    languages = sorted(set(table["label"]))
    n = np.zeros((len(languages), BINS))
    place = {name: i for i, name in enumerate(languages)}
    n[[place[x] for x in table["label"]], table["bin"]] += table["n"]
    share = n / np.maximum(n.sum(axis=1, keepdims=True), 1)
    return TextModel(languages, np.log((1 - NOISE) * share + NOISE / BINS))


def address_parts(url: Column) -> list[Column]:
    """(host, domain, suffix) of an address: the domain is the host's last two labels."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    labels = F.split(host, r"\.")
    return [host, F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(host),
            F.when(F.size(labels) > 1, F.element_at(labels, -1))]


def declared_language(html: Column) -> Column:
    """Primary subtag of the language an html element declares."""
    tag = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", 1))
    return F.when(tag != "", tag)


def scored(frame: DataFrame, text: str, keep: Sequence[str], model: TextModel) -> DataFrame:
    """``keep`` and the text's log likelihoods ``ll`` and trigrams ``grams``."""
    text_batches(frame.sparkSession)
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.likelihoods(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, keep), pa.array([x for x, _ in found], pa.list_(pa.float64())),
                 pa.array([n for _, n in found], pa.int64())], [*keep, "ll", "grams"])

    slim = frame.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = slim.drop("_text").withColumns({"ll": F.array().cast("array<double>"), "grams": F.lit(0).cast("long")}).schema
    return slim.mapInArrow(run, schema)


def _best(scores: Sequence[Column]) -> Column:
    return F.array_position(F.array(*scores), F.array_max(F.array(*scores))).cast("int") - 1


def identify(frame: DataFrame, text: str, model: TextModel, declared: Column | None = None,
             suffix: Column | None = None, levels: Sequence[Column] = (), keep: Sequence[str] | None = None) -> DataFrame:
    """Language, posterior and verdict of every row.

    Returns ``row`` (the input columns, or those of ``keep``), ``language`` (``und`` if none),
    ``posterior`` and ``kept``.  What ``row`` holds goes through Python and into the staged
    scores; whoever doesn't need the texts back leaves them out.  The text's likelihood in each language meets

    * how often texts of that language declare what this one declares,
    * how often they come from this address suffix,
    * the share of the language among the rows of the same host, smoothed towards that of the
      next of ``levels`` (host, domain and so on, the narrowest first) and at last of all rows.

    All of these are counted over all other rows, by the language of their text alone, with
    grouped aggregations: a row's own vote is left out, so that a host, a suffix or a declared
    language seen once confirms nothing.  Only rows with letters count.  Missing evidence
    changes nothing.  Texts are scored once; the scores are kept in a staged copy of the rows.

    Rows without letters (null, empty, marks only) and rows that no language explains better
    than chance are ``und`` and not kept; ties go to the language first in code point order.
    With a model that knows no language every row is kept, language null.  An empty table gives
    an empty result.
    """
    names = model.languages
    missing = F.lit(None).cast("string")
    base = frame.select(
        F.struct(*[frame[f"`{c}`"] for c in (frame.columns if keep is None else keep)]).alias("row"), frame[f"`{text}`"].alias("_t"),
        (missing if declared is None else declared).alias("declared"), (missing if suffix is None else suffix).alias("suffix"),
        *[c.cast("string").alias(f"level{i}") for i, c in enumerate(levels)])
    if not names:
        return base.select("row", missing.alias("language"), F.lit(None).cast("double").alias("posterior"),
                           F.lit(True).alias("kept"))
    keys = ["declared", "suffix", *[f"level{i}" for i in range(len(levels))]]
    ll = [F.element_at("ll", i + 1) for i in range(len(names))]
    final = stage(scored(base, "_t", ["row", *keys], model).withColumn("_top", F.when(F.col("grams") > 0, _best(ll))),
                  "language-scores")
    alone = final.filter("grams > 0").select(*keys, "_top")
    counts = [F.sum((F.col("_top") == i).cast("long")).alias(f"n{i}") for i in range(len(names))]
    again = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))]
    cube = stage(alone.groupBy(*keys).agg(*counts), "language-counts")
    total = cube.agg(*again).first()
    total = [int(x or 0) for x in total]
    own = [F.coalesce(F.col("_top") == k, F.lit(False)).cast("long") for k in range(len(names))]
    voted = F.col("_top").isNotNull().cast("long")
    everywhere = [(t - o + 1.0) / (sum(total) - voted + len(names)) for t, o in zip(total, own)]

    every_language = F.aggregate(F.array(*[f"n{i}" for i in range(len(names))]), F.lit(0).cast("long"), lambda s, x: s + x)

    def table(key: str) -> DataFrame:
        return stage(cube.filter(F.col(key).isNotNull()).groupBy(key).agg(
            *[F.sum(f"n{i}").alias(f"{key}_n{i}") for i in range(len(names))],
            F.sum(every_language).alias(f"{key}_all")), f"language-{key}")

    for key in keys:
        if not (key == "declared" and declared is None or key == "suffix" and suffix is None):
            final = join_small(final, table(key), [key], "left")
        else:
            final = final.withColumns({f"{key}_{i}": F.lit(None).cast("long")
                                       for i in [*[f"n{k}" for k in range(len(names))], "all"]})
    prior = everywhere
    for i in reversed(range(len(levels))):
        near = [F.coalesce(F.col(f"level{i}_n{k}") - own[k], F.lit(0)) for k in range(len(names))]
        every = F.coalesce(F.col(f"level{i}_all") - voted, F.lit(0))
        prior = [(n + KAPPA * p) / (every + KAPPA) for n, p in zip(near, prior)]

    def given(key: str, k: int) -> Column:
        """How much likelier language k makes this value than all languages together do; null if no other row has it."""
        others = F.col(f"{key}_all") - voted
        overall = (others + 1.0) / (sum(total) - voted + 1.0)
        return F.when(others > 0, F.log(
            ((F.col(f"{key}_n{k}") - own[k] + KAPPA * overall) / (total[k] - own[k] + KAPPA)) / overall))

    logits = [ll[k] + F.log(prior[k]) + F.coalesce(given("declared", k), F.lit(0.0))
              + F.coalesce(given("suffix", k), F.lit(0.0)) for k in range(len(names))]
    logits.append(F.element_at("ll", len(names) + 1) + F.log(F.lit(STRANGE)))
    final = final.withColumn("_logits", F.array(*logits))
    top = F.array_max("_logits")
    posterior = 1 / F.aggregate("_logits", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    best = F.array_position("_logits", top).cast("int")
    known = (F.col("grams") > 0) & (best <= len(names)) & (posterior >= LEAST)
    named = F.element_at(F.array(*map(F.lit, names), F.lit(UNKNOWN)), best)
    return final.select("row", F.when(known, named).otherwise(UNKNOWN).alias("language"),
                        F.when(F.col("grams") > 0, posterior).otherwise(0.0).alias("posterior"), known.alias("kept"))
