"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import words_of

SHINGLE = 5
ONE_IN = 4      # the fixed fraction of the hash range that is kept
AT_LEAST = 32    # smallest hashes a short text keeps besides

_MIN, _SPAN = -(1 << 63), 1 << 64


def _threshold(one_in: int) -> int:
    return _MIN + _SPAN // one_in


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """One hash for each word, over it and the width - 1 words before it.

    Places before the first word count as blanks, so texts shorter than a shingle have
    shingles as well.  Empty for null and for texts without words.
    """
    def over(words: Column) -> Column:
        return F.transform(words, lambda w, i: F.xxhash64(
            w, *[F.coalesce(F.get(words, i - k), F.lit("")) for k in range(1, width)]))
    return F.transform(F.array(words_of(text)), over)[0]


def sketch(text: Column, width: int = SHINGLE, one_in: int = ONE_IN, at_least: int = AT_LEAST) -> Column:
    """Sorted distinct shingle hashes below a fixed fraction of the hash range.

    The threshold is the same for every document, so sketches of parts merge by union
    (:func:`merged`) and a passage keeps its hashes inside a text of any length.  A text with
    fewer than ``at_least`` such hashes keeps its ``at_least`` smallest ones; a sketch that
    is smaller than that is the text's whole set.  Null and empty texts have the empty
    sketch.  Equal texts have equal sketches.
    """
    limit = F.lit(_threshold(one_in))

    def of(hashes: Column) -> Column:
        below = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < limit)))
        return F.when(F.size(below) >= at_least, below).otherwise(
            F.slice(F.array_sort(F.array_distinct(hashes)), 1, at_least))
    return F.transform(F.array(shingle_hashes(text, width)), of)[0]


def merged(one: Column, other: Column, one_in: int = ONE_IN, at_least: int = AT_LEAST) -> Column:
    """Sketch of two texts' shingles together."""
    both = F.array_sort(F.array_union(one, other))
    below = F.filter(both, lambda h: h < F.lit(_threshold(one_in)))
    return F.when(F.size(below) >= at_least, below).otherwise(F.slice(both, 1, at_least))


def _bound(kept: Column, one_in: int, at_least: int) -> Column:
    """Largest hash up to which a sketch is complete."""
    return (F.when(F.size(kept) < at_least, F.lit((1 << 63) - 1))
            .otherwise(F.greatest(F.element_at(kept, -1), F.lit(_threshold(one_in) - 1))))


def containment(one: Column, other: Column, one_in: int = ONE_IN, at_least: int = AT_LEAST) -> Column:
    """Share of the smaller text's shingles that the larger one has, from 0 to 1.

    Estimated on the hashes up to which both sketches are complete.  Equal sketches give 1,
    an empty one against another 0.  Null if one of them has no hash there, so that nothing
    can be said: against a long text a short one of n shingles has none with chance
    (1 - 1 / ``one_in``) ** n.
    """
    def of(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        upto = F.least(_bound(a, one_in, at_least), _bound(b, one_in, at_least))
        a, b = F.filter(a, lambda h: h <= upto), F.filter(b, lambda h: h <= upto)
        smaller = F.least(F.size(a), F.size(b))
        return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller)
    pair = F.struct(one.alias("a"), other.alias("b"))
    return (F.when(one == other, F.lit(1.0))
            .when((F.size(one) == 0) | (F.size(other) == 0), F.lit(0.0))
            .otherwise(F.transform(F.array(pair), of)[0]))


def as_text(kept: Column) -> Column:
    """A sketch as one string of hexadecimal hashes."""
    return F.array_join(F.transform(kept, lambda h: F.lower(F.hex(h))), ",")
