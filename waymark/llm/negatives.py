"""Hard negatives: for each anchor and each of its nearest positives, the best rows of other labels a margin below.

Vectors become integers, so every score is an exact inner product. Anchors and
candidates are dealt to blocks; each pair of blocks is one task's work, which
multiplies an anchor block by tiles of candidates with Strassen's recursion and
keeps the best few of each anchor in heaps. Heaps of a block's tiles are merged
in the task, those of different tasks by a ranked window, of which Spark keeps
few rows an anchor before it shuffles.

Two rounds: positives need only the rows of the anchor's label, which are dealt
within the label, by as many blocks as it has rows for; windows need all rows.
A hot label therefore has more blocks, not larger ones, and a row's block comes
from its row number, so equal rows and equal ids spread as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import checkpointed, join_hot

#: Below this many rows, columns or inner terms a product isn't split further.
LEAF = 32
#: Components of vectors that a block of candidates holds at most on average; an anchor block has a quarter.
BLOCK_VALUES = 1 << 20
#: Anchors and candidates of a tile.
TILE = (512, 2048)
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class MiningOptions:
    """``low`` and ``high`` are hundredths of the positive's score between which a negative's score lies."""

    scale: int = 256
    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of integer matrices by Strassen's seven products a level; odd sizes are padded by zeros.

    Sums wrap around in int64 as in any ring, so the result is exact where it
    fits itself; object arrays (Python's integers) are always exact.
    """
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * l), a.dtype)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def integers(vectors: pd.Series, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of every component, as rows of ``width`` (shorter ones end in zeros); Python's integers where int64 can't hold them."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        scaled = np.floor(out * scale)
    if np.abs(scaled).max(initial=0) < 1 << 53:
        return scaled.astype(np.int64)
    # from 2**53 on a double is a whole number, and so is its multiple
    return np.array([[int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(x * scale)) for x in row] for row in out.tolist()], object).reshape(out.shape)


class Heaps:
    """The best ``size`` candidates of each of ``n`` keys, mergeable: rows of rising numbers, ``floor`` where there is none.

    A number is ``score * places + places - 1 - place``. ``place`` numbers the
    candidates of a block in the order in which they settle ties, so the larger
    number is the better candidate.
    """

    def __init__(self, n: int, size: int, floor: int, kind: type):
        self.size = size
        self.best = np.full((n, size), floor, kind)

    def merge(self, part: slice, found: np.ndarray) -> None:
        both = np.concatenate([self.best[part], found], axis=1)
        both.sort(axis=1)
        self.best[part] = both[:, -self.size :]


class BlockPair:
    """Scores of an anchor block with a candidate block, tile by tile.

    Where int64 might not hold a number, Python's integers are used; a score
    beyond a long counts as the largest or smallest long.
    """

    def __init__(self, anchors: np.ndarray, candidates: np.ndarray):
        self.places = max(len(candidates), 1)
        top = [int(np.abs(x).max(initial=0)) for x in (anchors, candidates)]
        small = top[0] * top[1] * max(anchors.shape[1], 1) * 2 * self.places < 1 << 62
        self.kind, self.limit = (np.int64, 1 << 62) if small else (object, 1 << 130)
        self.anchors, self.candidates = anchors.astype(self.kind), candidates.astype(self.kind).T

    def heaps(self, n: int, size: int) -> Heaps:
        return Heaps(n, size, -self.limit, self.kind)

    def tiles(self, keep: Callable[[slice, slice], np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
        """Slice of the anchors and the sorted numbers of the candidates of a tile, for each tile."""
        n_a, n_c = len(self.anchors), self.candidates.shape[1]
        for i in range(0, n_a, TILE[0]):
            rows = slice(i, min(i + TILE[0], n_a))
            for j in range(0, n_c, TILE[1]):
                part = slice(j, min(j + TILE[1], n_c))
                tile = strassen(self.anchors[rows], self.candidates[:, part])
                if self.kind is object:
                    tile = np.minimum(np.maximum(tile, -_LONG), _LONG)
                numbers = tile * self.places + np.arange(self.places - 1 - part.start, self.places - 1 - part.stop, -1)
                numbers = np.where(keep(rows, part), numbers, -self.limit)
                numbers.sort(axis=1)
                yield rows, numbers

    def number(self, score: int, last: bool) -> int:
        """The least, or the last, number of a score, within the limits of the kind."""
        return max(min(score * self.places + (self.places - 1) * last, self.limit), 1 - self.limit)

    def found(self, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the heaps, place and score of all that was found."""
        who, at = np.nonzero(best > -self.limit)
        numbers = best[who, at]
        return who, (self.places - 1 - numbers % self.places).astype(np.int64), (numbers // self.places).astype(np.int64)


def _block(rows: pd.DataFrame, width: int, scale: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows in the order of ties (ids rising, null last, then row number) with their integers."""
    rows = rows.sort_values(["unnamed", "vec_id", "row"], ignore_index=True)
    return rows, integers(rows["vector"], scale, width)


def _width(*sides: pd.DataFrame) -> int:
    return max((len(v) for s in sides for v in s["vector"]), default=0)


def _positives(anchors: pd.DataFrame, candidates: pd.DataFrame, options: MiningOptions) -> pd.DataFrame:
    """Best rows of an anchor block in a candidate block of the same label, without the anchor's own row."""
    width = _width(anchors, candidates)
    anchors, a = _block(anchors, width, options.scale)
    candidates, c = _block(candidates, width, options.scale)
    own, theirs = anchors["row"].to_numpy(), candidates["row"].to_numpy()
    pair = BlockPair(a, c)
    heaps = pair.heaps(len(a), options.positives)
    for rows, numbers in pair.tiles(lambda i, j: own[i, None] != theirs[None, j]):
        heaps.merge(rows, numbers[:, -options.positives :])
    return _listed(pair, heaps.best, anchors, candidates, 1)


def _negatives(anchors: pd.DataFrame, candidates: pd.DataFrame, options: MiningOptions) -> pd.DataFrame:
    """Best rows of other labels in each window of an anchor block; ``wanted`` has the positives' scores of an anchor."""
    width, k, size = _width(anchors, candidates), options.positives, options.negatives
    anchors, a = _block(anchors, width, options.scale)
    candidates, c = _block(candidates, width, options.scale)
    label, labels = anchors["label"].to_numpy(), candidates["label"].to_numpy()
    pair = BlockPair(a, c)
    heaps = [pair.heaps(len(a), size) for _ in range(k)]
    # low * positive <= 100 * score <= high * positive, in numbers; an anchor with fewer positives has empty windows
    low, top = np.full((k, len(a)), pair.limit, pair.kind), np.full((k, len(a)), -pair.limit, pair.kind)
    for i, positives in enumerate(anchors["wanted"]):
        for j, score in enumerate(map(int, positives)):
            low[j, i] = pair.number(-(-score * options.low // 100), last=False)
            top[j, i] = pair.number(score * options.high // 100, last=True)
    back = np.arange(-size, 0)
    for rows, numbers in pair.tiles(lambda i, j: label[i, None] != labels[None, j]):
        for j in range(k):
            at = (numbers <= top[j, rows, None]).sum(axis=1)[:, None] + back
            found = np.take_along_axis(numbers, np.maximum(at, 0), axis=1)
            heaps[j].merge(rows, np.where((at >= 0) & (found >= low[j, rows, None]), found, -pair.limit))
    return _listed(pair, np.stack([h.best for h in heaps], axis=1).reshape(-1, size), anchors, candidates, k)


def _listed(pair: BlockPair, best: np.ndarray, anchors: pd.DataFrame, candidates: pd.DataFrame, windows: int) -> pd.DataFrame:
    who, place, score = pair.found(best)
    return pd.DataFrame(
        {
            "anchor": anchors["row"].to_numpy()[who // windows],
            "window": (who % windows).astype(np.int32),
            "row": candidates["row"].to_numpy()[place],
            "vec_id": pd.arrays.IntegerArray(candidates["vec_id"].to_numpy()[place], candidates["unnamed"].to_numpy()[place]),
            "score": score,
        }
    )


FOUND = "anchor long, window int, row long, vec_id long, score long"


def _best(found: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Merge the heaps of all tasks: the first ``size`` of each key by score, then id, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def _dealt(row: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(row, F.lit(seed)), blocks)


def mine(vectors: DataFrame, is_anchor: Column, options: MiningOptions = MiningOptions()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, vector, label).

    Rows with a null label or vector, or a null or non-finite component, take no
    part. A row's score is its integer inner product with the anchor, components
    being ``floor(scale * x)``; vectors of different lengths are compared as if
    the shorter one ended in zeros, and a score beyond a long counts as the
    largest or smallest long. Higher scores come first, then smaller vec_id, a
    null one last. Positives are the first rows of the anchor's label but itself;
    negatives the first of other labels between ``low`` and ``high`` hundredths
    of the positive's score. Repeated rows are rows of their own: a repeated
    anchor is mined twice, and each has the other for a positive. A positive
    without negatives gives no row. Other columns are ignored; an empty table
    gives no rows.
    """
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull()
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "vector", "label", F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.where(usable & F.coalesce(finite, F.lit(False)))
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    n, longest = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    per_block = max(1, BLOCK_VALUES // max(longest or 1, 1))
    per_anchor_block = max(1, per_block // 4)

    # blocks of each label, and of all rows
    sizes = rows.groupBy("label").agg(
        F.ceil(F.count("*") / per_block).alias("parts"), F.ceil(F.count_if("is_anchor") / per_anchor_block).alias("anchor_parts")
    )
    sizes = checkpointed(sizes.where("anchor_parts > 0"))
    sized = join_hot(rows, sizes, "label")
    keys, zero = ["label", "a", "c"], F.lit(0).cast("long")
    each = F.explode(F.sequence(zero, F.col("parts") - 1))
    each_anchor = F.explode(F.sequence(zero, F.col("anchor_parts") - 1))
    deal_a, deal_c = _dealt(F.col("row"), F.col("anchor_parts"), 1), _dealt(F.col("row"), F.col("parts"), 2)
    # pandas would make floating numbers of longs with nulls
    fields = [F.coalesce("vec_id", F.lit(0).cast("long")).alias("vec_id"), F.col("vec_id").isNull().alias("unnamed"), *[F.col(c).alias(c) for c in ("row", "vector", "label")]]
    left = sized.where("is_anchor").select(deal_a.alias("a"), each.alias("c"), *fields)
    right = sized.select(each_anchor.alias("a"), deal_c.alias("c"), *fields)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, c: _positives(a, c, options), FOUND)
    positives = checkpointed(_best(found, ["anchor"], options.positives).select("anchor", F.col("rank").alias("nth"), "vec_id", "score"))

    wanted = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "score"))).getField("score").alias("wanted"))
    anchors = rows.where("is_anchor").join(wanted, F.col("row") == F.col("anchor"))
    n_anchors = anchors.count()
    parts, anchor_parts = -(-n // per_block), -(-n_anchors // per_anchor_block)
    if not n_anchors:
        parts = anchor_parts = 1
    keys = ["a", "c"]
    each = F.explode(F.sequence(zero, F.lit(parts - 1).cast("long")))
    each_anchor = F.explode(F.sequence(zero, F.lit(anchor_parts - 1).cast("long")))
    left = anchors.select(_dealt(F.col("row"), F.lit(anchor_parts), 1).alias("a"), each.alias("c"), *fields, "wanted")
    right = rows.select(each_anchor.alias("a"), _dealt(F.col("row"), F.lit(parts), 2).alias("c"), *fields)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, c: _negatives(a, c, options), FOUND)
    negatives = _best(found, ["anchor", "window"], options.negatives)

    chosen = positives.select("anchor", (F.col("nth") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = rows.where("is_anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = negatives.join(chosen, ["anchor", "window"]).join(named, "anchor")
    return out.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
