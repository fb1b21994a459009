"""Benchmark decontamination by pigeonhole edit matching.

Test items are cut into passages, each with an error budget; a passage is
split into one piece more than its budget, so that within the budget one
piece at least stands in the document unchanged. Piece hits come from one
automaton, and the place around a hit is verified with Myers' bit-parallel
edit distance.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import free_name, sent_if_small
from spanveil.llm.tokens import released
from spanveil.plans.tables import stored

Passage = tuple[int, str, int]  # item (its place in the list), text, error budget


def normal(text: str | None) -> str:
    """Lower case, with one space wherever there is white space."""
    return " ".join((text or "").lower().split())


def passages(item: int, text: str | None, *, size: int, errors: float, least: int) -> list[Passage]:
    """Overlapping passages of ``size`` characters, each starting half a size after the
    last; a shorter item is one, and one under ``least`` characters is none."""
    body = normal(text)
    if len(body) < least:
        return []
    starts = list(range(0, max(1, len(body) - size + 1), size // 2))
    if starts[-1] + size < len(body):
        starts.append(len(body) - size)
    return [(item, part, int(errors * len(part))) for part in (body[s : s + size] for s in starts)]


def distance_within(pattern: str, text: str, most: int) -> int | None:
    """The least edit distance between ``pattern`` and any part of ``text``, None if over ``most``.

    One bit for each place of the pattern; a step for each character of the text.
    """
    m = len(pattern)
    if not m:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    all_, last = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best = all_, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        v = eq | minus
        h = (eq & plus) + plus ^ plus | eq
        up = minus | ~(h | plus) & all_
        down = plus & h
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up = up << 1 & all_  # a match may start anywhere
        down = down << 1 & all_
        plus = down | ~(v | up) & all_
        minus = up & v
        best = min(best, score)
    return best if best <= most else None


class Matcher:
    def __init__(self, passages: list[Passage]):
        self.passages = passages
        self.machine = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for p, (_, text, budget) in enumerate(passages):
            cuts = [len(text) * k // (budget + 1) for k in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((p, a))
        for piece, spots in pieces.items():
            self.machine.add_word(piece, (len(piece), spots))
        if pieces:
            self.machine.make_automaton()

    def find(self, text: str | None) -> dict[int, int]:
        """Items with a passage in the text, and the least distance of any."""
        body, found, tried, done = normal(text), {}, set(), set()
        if not len(self.machine) or not body:
            return found
        for end, (n, spots) in self.machine.iter(body):
            for p, offset in spots:
                start = end + 1 - n - offset
                if p in done or (p, start) in tried:
                    continue
                tried.add((p, start))
                item, passage, budget = self.passages[p]
                if body.startswith(passage, max(0, start)):
                    d = 0
                else:
                    d = distance_within(passage, body[max(0, start - budget) : start + len(passage) + budget], budget)
                if d is not None:
                    found[item] = min(d, found.get(item, d))
                    if d == 0:
                        done.add(p)
        return found


_HELD: list = []  # the last block's passages and automaton, in each Python worker


def _matcher(made: list[Passage]) -> Matcher:
    if not _HELD or _HELD[0] is not made:
        _HELD[:] = [made, Matcher(made)]
    return _HELD[1]


def _search(shared):
    def run(batches):
        for batch in batches:
            names, made = shared.value
            matcher = _matcher(made)
            rows, items, dist = [], [], []
            for k, text in enumerate(batch.column("body").to_pylist()):
                found = matcher.find(text)
                for item, d in found.items():
                    rows.append(k)
                    items.append(names[item])
                    dist.append(d)
            arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())), batch.column("digest").take(pa.array(rows, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(items, pa.int64()), pa.array(dist, pa.int32())], names=["doc_id", "digest", "item_id", "distance"]
            )

    return run


def drop_matcher() -> None:
    _HELD.clear()


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int):
    """The test items in blocks of about ``block_chars`` characters, one block at a time on the driver."""
    rows = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect()
        yield [r["item"] for r in part], [r["text"] for r in part]


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 120,
    errors: float = 0.05,
    least: int = 20,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """(doc_id, digest, item_id, distance): the passages of test items found in documents.

    Both sides are lower-cased and white space is folded. An item is found if
    one of its passages of ``size`` characters (the item itself, if shorter)
    stands anywhere in the document with at most ``errors`` times its length
    edits; ``distance`` is the least. Items under ``least`` characters are
    left out. Documents stay where they are and are read whole, once for each
    block of test items: a block has a fixed size, so what is broadcast is
    bounded however many items there are, and all items are searched.

    NULL or empty documents have no hit, NULL or empty items find none.
    ``digest`` tells rows of one id apart by their text. Repeated rows give
    repeated hits. Equal items are all reported. Other columns are not read.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).cast("string").alias("body"))
    schema = f"doc_id {kind}, digest long, item_id long, distance int"
    found = None
    for names, texts in item_blocks(items, item_col, item_text_col, block_chars):
        made = [p for i, text in enumerate(texts) for p in passages(i, text, size=size, errors=errors, least=least)]
        part = rows.mapInArrow(released(_search(spark.sparkContext.broadcast((names, made))), drop_matcher), schema)
        found = part if found is None else found.union(part)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a passage of a test item, with all columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    key, digest = free_name(docs, "id_"), free_name(docs, "digest_")
    hits = contaminated(docs, items, **options).select(F.col("doc_id").alias(key), F.col("digest").alias(digest)).distinct()
    hits = stored(hits, "contaminated")
    return docs.join(sent_if_small(hits), docs[id_col].eqNullSafe(hits[key]) & (F.xxhash64(docs[text_col]) == hits[digest]), "left_anti")


def verdicts(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id, contaminated, item_ids, distance`` for each row of ``docs``; ``item_ids`` ascend."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    hits = contaminated(docs, items, **options).groupBy("doc_id", "digest")
    hits = hits.agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.min("distance").alias("distance"))
    hits = hits.select(F.col("doc_id").alias("hit_id"), "digest", "item_ids", "distance")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("own"))
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("own") == F.col("digest")), "left")
    none = F.array().cast("array<bigint>")
    return joined.select(F.col("doc_id").alias(id_col), F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), "distance")
