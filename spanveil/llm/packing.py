"""Packing pieces of documents into sequences: a configuration linear program
over the length histogram, solved by multiplicative weights.

A pattern says how many pieces of each length share a sequence. The program
asks for the fewest sequences whose patterns cover the histogram. Weights sit
on the lengths; the pattern of most weight is found by a knapsack dynamic
program, taken a few times, and the weights of what it covers shrink. The
result is rounded down, and what is left is packed best-fit decreasing, by
lengths as well. All of this sees a histogram of at most ``capacity`` entries,
however many documents there are.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.common import text_of
from spanveil.llm.tokens import drop_encoders, encoder, released
from spanveil.plans.tables import stored

Pattern = tuple[tuple[int, int], ...]  # (length, how often)


def best_pattern(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> Pattern:
    """The pattern of most weight: the unbounded knapsack. ``lengths`` ascend."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = fits[c]
        if k:
            value = best[c - lengths[:k]] + weights[:k]
            i = int(value.argmax())
            if value[i] > best[c]:
                best[c], take[c] = value[i], i
    found, c = Counter(), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            found[int(lengths[take[c]])] += 1
            c -= int(lengths[take[c]])
    return tuple(sorted(found.items(), reverse=True))


def solve(counts: dict[int, int], capacity: int, *, rounds: int = 600, step: float = 0.3, rate: float = 1.0, rare: int = 8) -> dict[Pattern, float]:
    """Fractional numbers of patterns, none over the histogram.

    The weight of a length starts a little above its size, so that long pieces
    go first and short ones stay to fill gaps with, and falls by the factor
    exp(-rate) as the length gets covered. A round takes the pattern of most
    weight for a ``step`` of what its scarcest length has left. Lengths with
    fewer than ``rare`` pieces are left to the rounding.
    """
    lengths = np.array(sorted(x for x, n in counts.items() if n >= rare), np.int64)
    need = np.array([counts[x] for x in lengths.tolist()], float)
    have, place, found = np.zeros(len(need)), {x: i for i, x in enumerate(lengths.tolist())}, Counter()
    for _ in range(rounds):
        open_ = have + 1 <= need
        pattern = best_pattern(lengths[open_], (lengths**1.1 * np.exp(-rate * have / need))[open_], capacity)
        if not pattern:
            break
        spots = [place[x] for x, _ in pattern]
        times = np.array([k for _, k in pattern], float)
        much = max(1.0, step * float(((need - have)[spots] / times).min()))
        have[spots] += much * times
        found[pattern] += much
    return dict(found)


def round_down(found: dict[Pattern, float], counts: dict[int, int]) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Whole numbers of patterns that use no piece twice, and the pieces left."""
    left, taken = dict(counts), []
    for pattern, x in sorted(found.items(), key=lambda p: (-p[1], p[0])):
        n = min([int(x), *(left[length] // k for length, k in pattern)])
        if n:
            taken.append((pattern, n))
            for length, k in pattern:
                left[length] -= n * k
    return taken, {length: n for length, n in left.items() if n}


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a histogram; equal sequences are filled together."""
    room: dict[int, list[tuple[Pattern, int]]] = {}
    for length, n in sorted(left.items(), reverse=True):
        while n:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                fit, (pattern, m) = capacity, ((), -(-n // (capacity // length)))
            else:
                pattern, m = room[fit].pop()
                if not room[fit]:
                    del room[fit]
            each = fit // length
            full = min(m, n // each)
            rest = n - full * each if full < m else 0  # fewer than each: for one more sequence
            for k, times in ((each, full), (rest, int(rest > 0)), (0, m - full - int(rest > 0))):
                if times:
                    more = ((length, k),) if k else ()
                    room.setdefault(fit - k * length, []).append((pattern + more, times))
            n -= full * each + rest
    return [x for found in room.values() for x in found]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used, for all pieces of the histogram."""
    if any(x < 1 or x > capacity for x in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    whole = [(((capacity, 1),), counts[capacity])] if counts.get(capacity) else []
    shorter = {x: n for x, n in counts.items() if x < capacity}
    taken, left = round_down(solve(shorter, capacity), shorter)
    return whole + taken + best_fit(left, capacity)


def slots(patterns: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """For each length, ascending rows (first rank, first sequence, offset): the
    piece of rank r goes to sequence ``first sequence + r - first rank``."""
    rows: dict[int, list] = {}
    ranks, base = Counter(), 0
    for pattern, n in patterns:
        at = 0
        for length, k in pattern:
            for _ in range(k):
                rows.setdefault(length, []).append((ranks[length], base, at))
                ranks[length] += n
                at += length
        base += n
    return {length: np.array(x, np.int64) for length, x in rows.items()}


def _pieces(path: str, end_id: int | None, capacity: int):
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches):
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(encoder(path).ids(batch.column("body").to_pylist())):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n else [0]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(k)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            arrays = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            arrays += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _placer(table):
    def run(batches):
        rows = table.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                mine = length == x
                spot = rows[x][np.searchsorted(rows[x][:, 0], rank[mine], "right") - 1]
                sequence[mine], offset[mine] = spot[:, 1] + rank[mine] - spot[:, 0], spot[:, 2]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            arrays = [batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    return run


PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = 1024,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_rows: int = 200_000,
    release: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece.

    Texts are encoded whole and get the end id; only those longer than
    ``capacity`` are cut, into pieces of ``capacity`` ids of which the first
    may be shorter. Sequences hold at most ``capacity`` ids, without gaps.

    The histogram of lengths alone goes to the driver, and the patterns come
    back as rank ranges per length. Pieces of one length are numbered by
    hashed salts, as many as keep a salt near ``group_rows`` pieces, so one
    length may hold all documents.

    With ``release`` a worker gives up its tokenizer and the pieces it knows
    when a task ends: less memory between tasks and for other stages, more
    time in each task.

    NULL and empty texts have the end id alone (without one, no piece). NULL
    ids are ids like others. Repeated rows are packed as often. Other columns
    are not read. An empty table gives an empty result.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("body"))
    cut = _pieces(tokenizer, end_id, capacity)
    pieces = stored(rows.mapInArrow(released(cut, drop_encoders) if release else cut, PIECES.format(kind)), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    salts = max(1, -(-max(counts.values(), default=0) // group_rows))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("rank", F.row_number().over(inside).cast("long") - 1)
    if salts > 1:
        sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        ranked = ranked.join(bases, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_placer(table), PIECES.format(kind) + ", sequence_id long, offset long")
