"""Documents that belong together because they share values, and spans that belong together because they overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.operators.corpus import SALTS, link_documents
from spanveil.plans.tables import stored

MOST_ROUNDS = 64


def _least(edges: DataFrame) -> DataFrame:
    """For each node the least of its neighbours ``m``; added up on the map side, also for a hub of very many."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both).withColumn("m", F.least("u", "m")), "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    joined = edges.join(_least(edges), "u")
    down = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(joined.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``<id, group_id>`` for every node of an undirected edge: the least node it can be reached from.

    Large and small stars in turn: every round links nodes to smaller ones
    and, at the end, each to the least of its component. Rounds grow with the
    logarithm of the number of nodes. Each round is written to the shared
    folder, so that neither its lineage nor a lost executor brings it back.
    No component is ever collected in one task: a node's neighbours meet only
    in a minimum, and joins are on single nodes.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stored(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _digest(now)
    for _ in range(MOST_ROUNDS):
        now = stored(_small_star(stored(_large_star(now), "large-stars")), "small-stars")
        again = _digest(now)
        if again == seen:
            break
        seen = again
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    kept = now.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct()
    return kept.union(roots)


def identity_groups(values: DataFrame, id_col: str, salts: int = SALTS) -> DataFrame:
    """``<id, group_id, documents>``: documents that share a value, or a chain of shared values.

    ``values`` is :func:`corpus.doc_values`, stored; documents without a value
    are in no group and not in the result. ``group_id`` is the least id of the
    group, ``documents`` their number. Rows with a NULL id are left out.
    """
    known = values.where(F.col(id_col).isNotNull())
    linked = components(link_documents(known, id_col, salts), "hub", id_col)
    alone = known.select(F.col(id_col).alias("id")).distinct().join(linked.select("id"), "id", "left_anti")
    groups = stored(linked.union(alone.select("id", F.col("id").alias("group_id"))), "identity-groups")
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("documents"))
    return groups.join(sizes, "group_id").select(F.col("id").alias(id_col), "group_id", "documents")


def value_groups(values: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """``<group_id, entity_type, values, occurrences>``: what a group's documents share and hold.

    A value belongs to one group, that of any of its documents, so values are
    counted once each and meet their group by their first document.
    """
    per_value = values.groupBy("entity_type", "value").agg(F.min(id_col).alias(id_col), F.sum("n").alias("n"))
    joined = per_value.join(groups.select(id_col, "group_id"), id_col)
    return joined.groupBy("group_id", "entity_type").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("occurrences"))


# ------------------------------------------------------------- islands

REACH = 1 << 16  # code points of a document whose spans are put in order together


def span_islands(rows: DataFrame, id_col: str, reach: int = REACH) -> DataFrame:
    """Overlapping spans of a long table merged: ``<id, start, end, entity_type, score>``.

    Like ``merge_overlaps`` on an array: an island covers its spans and takes
    the type of the best one by score, then length, then name; spans that only
    touch stay apart. Empty spans and those without a place are left out.

    A document with very many spans is worked on by pieces of ``reach`` code
    points: running maxima within each piece, and over the pieces, of which
    there is one row each.
    """
    good = rows.where("start IS NOT NULL AND `end` IS NOT NULL AND start < `end`")
    best = F.struct(
        F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("score"), (F.col("end") - F.col("start")).alias("length"),
        F.col("entity_type").alias("entity_type"),
    )
    spans = good.select(F.col(id_col).alias("id"), "start", "end", best.alias("best")).withColumn("piece", F.floor(F.col("start") / F.lit(reach)))
    # equal places are one row, whatever their number
    spans = stored(spans.groupBy("id", "piece", "start", "end").agg(F.max("best").alias("best")), "span-places")
    before = Window.partitionBy("id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = spans.groupBy("id", "piece").agg(F.max("end").alias("last"))
    pieces = pieces.select("id", "piece", F.coalesce(F.max("last").over(before), F.lit(0)).alias("reached"))
    inside = Window.partitionBy("id", "piece").orderBy("start", "end")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.join(pieces, ["id", "piece"]).withColumn(
        "begins", (F.col("start") >= F.greatest("reached", F.coalesce(F.max("end").over(earlier), F.lit(0)))).cast("int")
    )
    # the number of an island: those that begin in earlier pieces, and in this one
    marked = stored(marked.withColumn("here", F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0))), "span-marks")
    starts = marked.groupBy("id", "piece").agg(F.sum("begins").alias("n"))
    starts = starts.select("id", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = marked.join(starts, ["id", "piece"]).withColumn("island", F.col("earlier") + F.col("here"))
    merged = numbered.groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("best").alias("best"))
    score = F.when(F.col("best.score") > float("-inf"), F.col("best.score")).alias("score")
    return merged.select(F.col("id").alias(id_col), "start", "end", F.col("best.entity_type").alias("entity_type"), score)
