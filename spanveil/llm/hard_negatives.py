"""Hard negatives: exact integer inner products by residues, then a window of scores under each positive.

Inner products of whole numbers are worked out modulo several primes, each as
one matrix product in float32 whose sums stay under 2^24 and so are exact, and
are put together by Chinese remaindering. As many primes are taken as the
measured vectors need, so that every score is the exact signed integer.

The anchors are a stated query set. They meet all rows in blocks: a bounded
block of anchors is sent to the tasks, which stream their rows past it and
keep a few best rows for each anchor. Nothing is emitted for other pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.plans.tables import stored

# The largest primes under 256.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)
LENGTH = 1024  # components of one product: 1024 * 125^2 < 2^24
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100  # a negative's score in percent of the positive's
ANCHORS = 16_384  # of one block, sent to every task: a few MB
ROWS = 4096  # rows and anchors of one product
SIDE = 512
FIRST = 256  # rows of a task's first product, which set its first limits
ROWS_PER_TASK = 65_536

HITS = "anchor long, place int, score long, vec_id long"


# ---------------------------------------------------------------- products


def primes_for(bound: int) -> tuple[int, ...]:
    """Primes whose product exceeds 4 times the largest absolute score."""
    product, n = 1, 0
    while product <= 4 * max(1, bound):
        if n == len(PRIMES):
            raise ValueError("scores of these vectors do not fit in 64 bits")
        product, n = product * PRIMES[n], n + 1
    return PRIMES[:n]


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """float32 whole numbers modulo ``p``, as small as can be in size."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def residues(vectors: np.ndarray, primes) -> list[np.ndarray]:
    """Component matrices modulo each prime, float32."""
    return [((vectors + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def combine(remainders: list[np.ndarray], primes) -> np.ndarray:
    """Signed integers from their remainders, digit by digit in a mixed radix.

    With balanced digits the value comes out with its sign. All steps but the
    last sum stay under 2^24.
    """
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        x, place = remainders[k], 1
        for d, q in zip(digits, primes):
            x = balanced(x - balanced(d * np.float32(place if place <= p // 2 else place - p), p), p)
            place = place * q % p
        if k:
            inverse = pow(place, -1, p)
            x = balanced(x * np.float32(inverse if inverse <= p // 2 else inverse - p), p)
        digits.append(x)
    out, place = digits[0].astype(np.int64), 1
    for d, q in zip(digits[1:], primes):
        place *= q
        out += d.astype(np.int64) * place
    return out


def products(left: list[np.ndarray], right: list[np.ndarray], primes) -> np.ndarray:
    """Exact inner products of all rows of ``left`` with all of ``right``, given by residues."""
    out = []
    for p, a, b in zip(primes, left, right):
        total = np.zeros((a.shape[0], b.shape[0]), np.float32)
        for k in range(0, a.shape[1], LENGTH):
            total = balanced(total + balanced(a[:, k : k + LENGTH] @ b[:, k : k + LENGTH].T, p), p)
        out.append(total)
    return combine(out, primes)


# --------------------------------------------------------------- selection


class _Best:
    """The best few rows of each slot: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, n: int):
        self.n, self.least = n, np.full(slots, np.iinfo(np.int64).min)  # a slot's n-th score, once it has so many
        self.full = np.zeros(slots, bool)
        none = np.zeros(0, np.int64)
        self.slot, self.score, self.id = none, none, none

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.zeros(len(self.full), bool)
        touched[slot] = True
        old = touched[self.slot]
        s, v, i = (np.concatenate([mine[old], new]) for mine, new in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((i, -v, s))
        s, v, i = s[order], v[order], i[order]
        first = np.r_[True, s[1:] != s[:-1]]
        rank = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        last = rank == self.n - 1
        self.full[s[last]], self.least[s[last]] = True, v[last]
        kept = rank < self.n
        self.slot, self.score, self.id = (
            np.concatenate([mine[~old], new[kept]]) for mine, new in ((self.slot, s), (self.score, v), (self.id, i))
        )

    def beaten(self, slots) -> np.ndarray:
        """Scores below these cannot enter; equal ones can, by a smaller id."""
        return np.where(self.full[slots], self.least[slots], np.iinfo(np.int64).min)


def _matrix(column, width: int) -> np.ndarray:
    """Lists as rows; components beyond a shorter one's end are zero."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _pieces(n: int, first: int = FIRST):
    """Ranges of rows, the first ones short."""
    at, step = 0, first
    while at < n:
        yield at, min(n, at + step)
        at, step = at + step, min(ROWS, step * 4)


def _hits(best: _Best, anchors: np.ndarray, places: int):
    order = np.argsort(best.slot, kind="stable")
    for k in range(0, len(order), 65_536):
        at = order[k : k + 65_536]
        slot = best.slot[at]
        arrays = [pa.array(anchors[slot // places]), pa.array((slot % places).astype(np.int32)), pa.array(best.score[at]), pa.array(best.id[at])]
        yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "place", "score", "vec_id"])


def _rows(batches, width: int):
    for b in batches:
        yield (b.column("row").to_numpy(), b.column("vec_id").to_numpy(), b.column("label").to_numpy(), _matrix(b.column("vector"), width))


def _positives(sent, primes, width: int):
    """The best other rows of each anchor's label."""

    def run(batches):
        anchors, labels, vectors = sent.value
        best = _Best(len(anchors), POSITIVES)
        left = residues(vectors, primes)
        of = {x: np.flatnonzero(labels == x) for x in np.unique(labels).tolist()}
        for rows, ids, kinds, matrix in _rows(batches, width):
            for x in np.unique(kinds).tolist():
                if x not in of:
                    continue
                same = np.flatnonzero(kinds == x)
                for a, b in _pieces(len(same)):
                    mine = same[a:b]
                    right = residues(matrix[mine], primes)
                    for k in range(0, len(of[x]), SIDE):
                        side = of[x][k : k + SIDE]
                        scores = products([r[side] for r in left], right, primes)
                        keep = scores >= best.beaten(side)[:, None]
                        keep &= anchors[side][:, None] != rows[mine][None, :]
                        i, j = np.nonzero(keep)
                        best.add(side[i], scores[i, j], ids[mine[j]])
        yield from _hits(best, anchors, 1)

    return run


def _negatives(sent, primes, width: int):
    """The best rows of another label in the window of scores of each positive of an anchor."""

    def run(batches):
        anchors, labels, vectors, scores_of = sent.value  # scores_of: for each anchor its positives' scores, -1 for none
        places = scores_of.shape[1]
        best = _Best(len(anchors) * places, NEGATIVES)
        left = residues(vectors, primes)
        low = -(-LOW * scores_of // HIGH)  # 80 p <= 100 n
        top = scores_of.max(1)
        for _rows_, ids, kinds, matrix in _rows(batches, width):
            for a, b in _pieces(len(ids)):
                right = residues(matrix[a:b], primes)
                for k in range(0, len(anchors), SIDE):
                    side = np.arange(k, min(k + SIDE, len(anchors)))
                    scores = products([r[side] for r in left], right, primes)
                    # what no positive of the anchor can take is left out at once
                    slots = side[:, None] * places + np.arange(places)
                    floor = np.maximum(low[side], best.beaten(slots))
                    floor = np.where(scores_of[side] < 0, np.iinfo(np.int64).max, floor).min(1)
                    keep = (scores >= floor[:, None]) & (scores <= top[side][:, None])
                    keep &= labels[side][:, None] != kinds[a:b][None, :]
                    i, j = np.nonzero(keep)
                    found = scores[i, j]
                    for p in range(places):
                        slot = side[i] * places + p
                        high = scores_of[side[i], p]
                        fits = (high >= 0) & (found <= high) & (found >= low[side[i], p]) & (found >= best.beaten(slot))
                        best.add(slot[fits], found[fits], ids[a:b][j[fits]])
        yield from _hits(best, anchors, places)

    return run


# ------------------------------------------------------------------- jobs


def prepared(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256
) -> DataFrame:
    """``vec_id, label, vector`` as whole numbers; rows that take no part are gone."""
    v = F.col(vector_col)
    label = F.col("label") if label is None else label
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(label.isNotNull() & F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(whole, F.lit(False)))
    scaled = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled.alias("vector"))


def _ranked(hits: DataFrame, most: int) -> DataFrame:
    """The best few over all tasks; ``rank`` from 1."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, is_anchor: Column, *, anchors_per_block: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows of :func:`prepared`.

    An anchor's positives are its ``POSITIVES`` best other rows of its label;
    for each, the ``NEGATIVES`` best rows of other labels are returned whose
    score is ``LOW`` to ``HIGH`` percent of the positive's. Higher scores come
    first, ties by smaller id.

    Rows are stored with a number of their own, so that rows of one id stay
    apart: a repeated anchor is two anchors, each a possible positive of the
    other. Vectors of unlike lengths are taken as padded with zeros; scores
    beyond 64 bits are refused before any product. An empty table, or one
    without anchors, gives no rows.

    Anchors are worked through in blocks of ``anchors_per_block``, which are
    fetched and sent to the tasks one block after another; the results of a
    block are stored before the next. Tasks keep 5 rows for each anchor, or 25.
    """
    spark = rows.sparkSession
    table = stored(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("anchor", F.coalesce(is_anchor, F.lit(False))), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = table.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"), F.max(square).alias("square"), F.count_if("anchor").alias("anchors")
    ).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not size["anchors"]:
        return empty
    # by Cauchy and Schwarz no score is larger than the largest square
    primes, width = primes_for(int(size["square"]) + 1), int(size["width"])
    tasks = max(spark.sparkContext.defaultParallelism, -(-size["n"] // ROWS_PER_TASK))
    spread = stored(table.drop("anchor").repartition(tasks, "row"), "spread-vectors")
    out = []
    blocks = -(-size["anchors"] // anchors_per_block)
    # numbers of anchors follow each other within a task of the stored table only; blocks are cut by hash
    own = table.where("anchor").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    for k in range(blocks):
        mine = own.where(F.col("block") == k).select("row", "vec_id", "label", "vector").toArrow().combine_chunks()
        if not mine.num_rows:
            continue
        numbers, ids, labels = (mine.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        matrix = _matrix(mine.column("vector").combine_chunks(), width)
        sent = spark.sparkContext.broadcast((numbers, labels, matrix))
        found = _ranked(spread.mapInArrow(_positives(sent, primes, width), HITS), POSITIVES).withColumn("place", F.col("rank") - 1)
        positives = stored(found.select("anchor", "place", "score", "vec_id"), "positives")
        sent.destroy()
        got = positives.select("anchor", "place", "score").toArrow()
        spot = np.argsort(numbers)
        at = spot[np.searchsorted(numbers[spot], got.column("anchor").to_numpy())]
        scores = np.full((len(numbers), POSITIVES), -1, np.int64)
        # below zero, 80 percent of a score are more than the score: no window
        scores[at, got.column("place").to_numpy()] = np.maximum(got.column("score").to_numpy(), -1)
        sent = spark.sparkContext.broadcast((numbers, labels, matrix, scores))
        near = _ranked(spread.mapInArrow(_negatives(sent, primes, width), HITS), NEGATIVES)
        near = near.select("anchor", "place", "rank", F.col("score").alias("negative_score"), F.col("vec_id").alias("negative_id"))
        named = table.where("anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        chosen = positives.select("anchor", "place", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
        done = near.join(chosen, ["anchor", "place"]).join(named, "anchor").select(*empty.columns)
        out.append(stored(done, "negatives"))
        sent.destroy()
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
