"""Spelling variants: words one edit apart, found with k-d trees over letter counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = np.frombuffer(bytes([*range(97, 123), *range(0xC0, 0x100)]), np.uint8)    # in Latin-1
CLIP = 15               # a letter's count above this is taken as this when boxes are pruned
SAMPLE = 1 << 16        # words, at most twice as many, on which the upper splits are fitted
CELL = 8192             # words of a cell
CELL_BYTES = 1 << 22    # and their letters
LEAF = 64
TALLY = 500_000         # distinct words a task holds before it hands its counts on

# A tree is the number of a cell or (letter, least count of the high side, low side, high side).
Tree = int | tuple


def word_counts(frame: DataFrame, id_: str, text: str, least_length: int = 5,
                change: Callable[[object], Callable[[str], str]] | None = None) -> DataFrame:
    """(word, n): how often each run of Latin letters of whole texts occurs, A-Z lower-cased.

    ``change``, given a row's id, returns what turns each of its words into the one counted.
    Words below ``least_length`` code points aren't counted.  Null and empty texts have none.
    Counts are summed in the tasks first, so a frequent word is one row per task.
    """
    slim = frame.select(frame[f"`{id_}`"].alias("id"), frame[f"`{text}`"].alias("text"))

    def packed(tally: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())],
                                          ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, id_here in enumerate(batch.column("id").to_pylist()):
                data = texts[i].as_py() or b""
                turn = change(id_here) if change else None
                for word, n in Counter(RUN.findall(data.lower().decode())).items():    # bytes lower A-Z only
                    if len(word) >= least_length:
                        word = turn(word) if turn else word
                        if len(word) >= least_length:
                            tally[word] += n
                if len(tally) > TALLY:
                    yield packed(tally)
                    tally = Counter()
        yield packed(tally)
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of Latin-1 codes."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Occurrences of every letter in every word, clipped."""
    many = np.empty((len(codes), len(LETTERS)), np.uint8)
    step = max(1, (1 << 20) // max(256, codes.shape[1]))
    for at in range(0, len(codes), step):
        part = codes[at:at + step]
        cells = part.astype(np.int64) + 256 * np.arange(len(part))[:, None]
        counts = np.bincount(cells.ravel(), minlength=256 * len(part)).reshape(-1, 256)
        many[at:at + step] = np.minimum(counts[:, LETTERS], CLIP)
    return many


def best_split(counts: np.ndarray) -> tuple[int, int] | None:
    """The (letter, least count) that halves the words best, if any tells them apart."""
    best, found = len(counts), None
    for t in range(1, int(counts.max(initial=0)) + 1):
        high = (counts >= t).sum(axis=0)
        off = np.abs(2 * high - len(counts))
        letter = int(off.argmin())
        if off[letter] < best and 0 < high[letter] < len(counts):
            best, found = int(off[letter]), (letter, t)
    return found


def fit_trees(words: list[str], weight: float, cell: int = CELL) -> dict[int, Tree]:
    """A tree of splits for every length in a sample whose words stand for ``weight`` each."""
    by_length: dict[int, list[str]] = {}
    for word in sorted(words):
        by_length.setdefault(len(word), []).append(word)
    numbers = iter(range(len(words) + 1))

    def grow(counts: np.ndarray) -> Tree:
        split = best_split(counts) if len(counts) * weight > cell and len(counts) >= 32 else None
        if split is None:
            return next(numbers)
        high = counts[:, split[0]] >= split[1]
        return (*split, grow(counts[~high]), grow(counts[high]))
    return {length: grow(letter_counts(letters_of(some))) for length, some in sorted(by_length.items())}


def visits(tree: Tree, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
    """Cells, each with the rows of ``counts`` that may have a partner there.

    A partner has at most ``up`` letters that the row lacks and lacks at most ``down`` of its.
    Every split a row is on the wrong side of takes one of these: the box of a cell is left
    out once its distance is too large.  With (0, 0) that is the one cell a row lies in.
    """
    def walk(node: Tree, rows: np.ndarray, above: np.ndarray, below: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        near = (above <= up) & (below <= down)
        rows, above, below = rows[near], above[near], below[near]
        if len(rows) and isinstance(node, tuple):
            high = counts[rows, node[0]] >= node[1]
            yield from walk(node[2], rows, above, below + high)
            yield from walk(node[3], rows, above + ~high, below)
        elif len(rows):
            yield node, rows
    none = np.zeros(len(counts), np.int8)
    yield from walk(tree, np.arange(len(counts)), none, none)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, letter counts) of the words of every length."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield length, at, letter_counts(letters_of([words[i] for i in at]))


def neighbours(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, n_near, best_n, best): number of words one edit away, and the most frequent one.

    ``words`` is a staged table of distinct ``word`` (Latin letters) with ``n`` and a number
    ``at``.  One inserted, deleted or replaced letter moves a word's vector of letter counts
    by an L1 distance of two at most, so it is searched among words of its own and the next
    greater length, in boxes no farther away than that:

    1. Splits (letter, count) for each length are fitted on a bounded sample and cut the
       words into cells.  A word lies in one cell and asks in all whose box is near enough;
       of two cells of one length only the lower asks the higher.
    2. A cell that has more words or letters than its bound, whatever the reason, is dealt
       into tiles and its questions go to all of them, so no task holds more.
    3. In a task a k-d tree over the tile's words prunes by boxes down to leaves, distances
       are taken there, and the letters of what is left are compared in order.

    Ties go to the smaller word in code-point order.  Words without neighbours have no row.
    """
    total = words.count()
    share = -(-total // SAMPLE) or 1
    sample = words.filter(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).select("word").limit(2 * SAMPLE)
    trees = fit_trees([r.word for r in sample.collect()], share, cell)

    def tree_of(length: int) -> Tree:
        return trees.get(length, -length)    # a length the sample lacks is one cell

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.zeros(batch.num_rows, np.int64)
            for length, at, counts in _by_length(batch.column("word").to_pylist()):
                for number, rows in visits(tree_of(length), counts, 0, 0):
                    own[at[rows]] = number
            yield batch.append_column("cell", pa.array(own))
    placed = stage(words.select("word", "n", "at").mapInArrow(place, "word string, n long, at long, cell long"), "placed")

    length = F.char_length("word")
    most = F.greatest(F.least(F.lit(cell), F.floor(F.lit(CELL_BYTES) / F.max(length))), F.lit(1))
    tiles = stage(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("tiles")), "tiles")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("cell").to_numpy()
            for length, at, counts in _by_length(batch.column("word").to_pylist()):
                for up, down, tree in ((1, 1, tree_of(length)), (1, 0, tree_of(length + 1))):
                    for number, rows in visits(tree, counts, up, down):
                        rows = at[rows]
                        rows = rows[own[rows] <= number] if down else rows
                        if len(rows):
                            yield (batch.select(["word", "n", "at"]).take(pa.array(rows))
                                   .append_column("cell", pa.array(np.full(len(rows), number)))
                                   .append_column("home", pa.array(own[rows] == number)))
    asked = join_small(placed.mapInArrow(ask, "word string, n long, at long, cell long, home boolean"), tiles, ["cell"])
    asked = asked.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    held = join_small(placed, tiles, ["cell"]).withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    columns = ["cell", "tile", "asks", "word", "n", "at", "home"]
    met = (held.withColumns({"asks": F.lit(False), "home": F.lit(True)}).select(columns).union(asked.withColumn("asks", F.lit(True)).select(columns))
           .repartition("cell", "tile").sortWithinPartitions("cell", "tile", "asks"))
    found = met.mapInArrow(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
            .select("word", "n_near", (-F.col("_best.less")).alias("best_n"), F.col("_best.word").alias("best")))


class Boxes:
    """A k-d tree over the letter counts of words of one length.

    Counts are kept in unary, one bit for each letter and count some word reaches, so L1
    distances are numbers of unequal bits, and a node's box is the AND and the OR of its words.
    """

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        counts = letter_counts(codes)
        tops = counts.max(axis=0)
        self.columns = [(letter, t) for letter in range(len(LETTERS)) for t in range(1, int(tops[letter]) + 1)]
        self.bits = self.unary(counts)
        self.root = self._grow(np.arange(len(codes)), counts)

    def unary(self, counts: np.ndarray) -> np.ndarray:
        flags = np.zeros((len(counts), -(-len(self.columns) // 64) * 64), bool)
        for k, (letter, t) in enumerate(self.columns):
            flags[:, k] = counts[:, letter] >= t
        return np.packbits(flags, axis=1).view(np.uint64)

    def _grow(self, at: np.ndarray, counts: np.ndarray) -> tuple:
        low, high = np.bitwise_and.reduce(self.bits[at]), np.bitwise_or.reduce(self.bits[at])
        split = best_split(counts[at]) if len(at) > LEAF else None
        if split is None:
            return low, high, at
        side = counts[at, split[0]] >= split[1]
        return low, high, self._grow(at[~side], counts), self._grow(at[side], counts)

    def near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``codes``, word of the tree) for all that are one edit apart.

        The rows are as long as the tree's words or one letter shorter.
        """
        asked, down = self.unary(letter_counts(codes)), int(codes.shape[1] == self.codes.shape[1])
        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def walk(node: tuple, rows: np.ndarray) -> None:
            bits = asked[rows]
            lacks = np.bitwise_count(node[0] & ~bits).sum(axis=1)
            exceeds = np.bitwise_count(bits & ~node[1]).sum(axis=1)
            rows = rows[(lacks <= 1) & (exceeds <= down)]
            if len(rows) and len(node) == 4:
                walk(node[2], rows)
                walk(node[3], rows)
            elif len(rows):
                step = max(1, (1 << 20) // len(node[2]))
                for at in range(0, len(rows), step):
                    part = rows[at:at + step]
                    apart = np.bitwise_count(asked[part, None, :] ^ self.bits[None, node[2], :]).sum(axis=2)
                    i, j = np.nonzero(apart <= 1 + down)
                    pairs.append((part[i], node[2][j]))
        walk(self.root, np.arange(len(codes)))
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = (np.concatenate(side) for side in zip(*pairs))
        step = max(1, CELL_BYTES // codes.shape[1])
        good = [one_edit(codes[i[at:at + step]], self.codes[j[at:at + step]]) for at in range(0, len(i), step)]
        good = np.concatenate(good) if good else np.zeros(0, bool)
        return i[good], j[good]


def one_edit(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which rows differ by one letter replaced, or put into the shorter ``one``."""
    length = one.shape[1]
    if other.shape[1] == length:
        return (one != other).sum(axis=1) == 1
    head = np.logical_and.accumulate(one == other[:, :length], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((one == other[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= length


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours inside each (cell, tile), whose words come before the questions."""
    here, held, tree = None, [], None
    for batch in batches:
        keys = list(zip(batch.column("cell").to_pylist(), batch.column("tile").to_pylist(), batch.column("asks").to_pylist()))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            cell, tile, asks = keys[begin]
            if (cell, tile) != here:
                here, held, tree = (cell, tile), [], None
            part = batch.slice(begin, end - begin).select(["word", "n", "at", "home"])
            if not asks:
                held.append(part)
                continue
            if tree is None:
                points = pa.Table.from_batches(held).combine_chunks()
                tree = Boxes(letters_of(points.column("word").to_pylist()))
            yield from _answers(part, points, tree)


def _answers(asked: pa.RecordBatch, points: pa.Table, tree: Boxes) -> Iterator[pa.RecordBatch]:
    words = asked.column("word").to_pylist()
    lengths = np.array([len(w) for w in words])
    step = max(1, min(CELL, CELL_BYTES // tree.codes.shape[1]))
    for length in np.unique(lengths).tolist():
        of_length = np.flatnonzero(lengths == length)
        for begin in range(0, len(of_length), step):
            rows = of_length[begin:begin + step]
            part = asked.take(pa.array(rows))
            i, j = tree.near(letters_of([words[k] for k in rows]))
            # A word that lies in this cell meets each partner there once.
            home = part.column("home").to_numpy(zero_copy_only=False)[i]
            go = ~home | (part.column("at").to_numpy()[i] < points.column("at").to_numpy()[j])
            if go.any():
                yield _summed(part, points, i[go], j[go])


def _summed(asked: pa.RecordBatch, points: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """One row per word of the pairs, both ways: its neighbours here and the best of them."""
    words = np.array([*asked.column("word").to_pylist(), *points.column("word").to_pylist()], object)
    n = np.concatenate([asked.column("n").to_numpy(), points.column("n").to_numpy()])
    me, peer = np.concatenate([i, j + asked.num_rows]), np.concatenate([j + asked.num_rows, i])
    used, at = np.unique(peer, return_inverse=True)
    rank = np.empty(len(used), np.int64)
    rank[np.argsort(words[used], kind="stable")] = np.arange(len(used))
    order = np.lexsort((rank[at], -n[peer], me))
    me, peer = me[order], peer[order]
    first = np.flatnonzero(np.append(True, me[1:] != me[:-1]))
    return pa.RecordBatch.from_arrays(
        [pa.array(words[me[first]].tolist(), pa.string()), pa.array(np.diff(np.append(first, len(me)))),
         pa.array(n[peer[first]]), pa.array(words[peer[first]].tolist(), pa.string())],
        ["word", "n_near", "best_n", "best"])


def variants(counts: DataFrame, least: int = 3, ratio: int = 2, cell: int = CELL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of ``counts`` with n >= ``least``.

    A word's form is its most frequent neighbour, if that one is ``ratio`` times as frequent;
    its root is where the chain of forms ends.  Frequency rises along a chain, so there are no
    circles, and following the forms' forms halves what is left of every chain in each round.
    """
    words = stage(counts.filter(F.col("n") >= least).withColumn("at", F.monotonically_increasing_id()), "words")
    near = neighbours(words, cell)
    formed = F.col("best_n") >= ratio * F.col("n")
    known = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    up = stage(known.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = up.select(F.col("word").alias("root"), F.col("root").alias("_beyond"))
        after = stage(up.join(beyond, "root", "left")
                      .select("word", F.coalesce("_beyond", "root").alias("root"), F.col("_beyond").isNotNull().alias("_moved")),
                      "roots")
        moved = after.filter("_moved").limit(1).count()
        up = after.select("word", "root")
        if not moved:
            return (known.join(up, "word", "left")
                    .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
