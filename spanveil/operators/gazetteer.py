"""Dictionary matching against a table of phrases, and spans from outside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.arrays import empty
from spanveil.functions.spans import SPAN_TYPE, surfaces
from spanveil.operators.analyze import combine_spans
from spanveil.operators.phrases import BROADCAST_BYTES, PhraseTable, hit_rows, joined_hits


def gazetteer_spans(
    df: DataFrame,
    phrases: DataFrame,
    id_col: str,
    text_col: str = "text",
    score: float = 0.85,
    ignore_case: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Spans ``<id, entity_type, start, end, score>`` of the phrases in a table.

    ``phrases`` has ``phrase`` and ``entity_type``. Its size is measured
    first: a small one is sent to the tasks and nothing is shuffled. For a
    large one the runs of words that pass a Bloom filter are shuffled, without
    the texts.
    """
    table = PhraseTable(phrases, ignore_case=ignore_case, broadcast_bytes=broadcast_bytes)
    rows = (hit_rows if table.small else joined_hits)(df, id_col, text_col, table)
    return rows.select(id_col, "entity_type", "start", "end", F.lit(float(score)).alias("score"))


def attach_spans(
    df: DataFrame, rows: DataFrame, id_col: str, spans_col: str = "spans", text_col: str = "text"
) -> DataFrame:
    """Add spans stored as rows (a model's output, say) to their documents.

    Exact duplicates keep their best score. Where ``df`` has spans already,
    both are combined; if those carry the text they cover, so do the new ones,
    cut from ``text_col``. A small span table is broadcast by Spark itself; keep
    large ones bucketed by the id, like the texts, to join without a shuffle.
    """
    explanation = F.col("explanation") if "explanation" in rows.columns else F.lit(None).cast("string")
    best = rows.groupBy(id_col, "entity_type", "start", "end").agg(
        F.max("score").cast("double").alias("score"), F.max_by(explanation, "score").alias("explanation")
    )
    span = F.struct(
        F.col("entity_type").alias("entity_type"),
        F.col("start").cast("int").alias("start"),
        F.col("end").cast("int").alias("end"),
        F.col("score").alias("score"),
        F.col("explanation").alias("explanation"),
    )
    grouped = best.groupBy(id_col).agg(F.collect_list(span).alias("_more"))
    joined = df.join(grouped, id_col, "left")
    more = F.coalesce(F.col("_more"), empty(SPAN_TYPE))
    own, fields = [], ["explanation"]
    if spans_col in df.columns:
        own.append(F.col(spans_col))
        if "text" in df.schema[spans_col].dataType.elementType.names:
            fields.append("text")
            more = surfaces(F.col(text_col), more, ["entity_type", "start", "end", "score", "explanation"])
    return joined.withColumn(spans_col, combine_spans(*own, more, fields=fields)).drop("_more")
