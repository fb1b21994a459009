"""Span and item files in the exchange form: one JSON object per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_TYPE = "array<struct<start:int,end:int,score:string,entity_type:string,analysis_explanation:string>>"
ITEM_FIELDS = "array<struct<start:int,end:int,entity_type:string,operator:string,text:string>>"


def write_results(df: DataFrame, path: str, id_col: str, spans_col: str = "spans", mode: str = "errorifexists") -> None:
    """``{id, results: [{start, end, score, entity_type, analysis_explanation}]}``.

    The score is text with two decimals, as readers of this form expect.
    """
    results = F.transform(
        F.col(spans_col),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.format_string("%.2f", s["score"]).alias("score"),
            s["entity_type"].alias("entity_type"),
            F.replace(F.coalesce(s["explanation"], F.lit("None")), F.lit('"'), F.lit("'")).alias(
                "analysis_explanation"
            ),
        ),
    )
    df.select(id_col, results.alias("results")).write.mode(mode).json(path)


def read_results(spark: SparkSession, path: str, id_col: str, id_type: str = "string") -> DataFrame:
    """``<id, spans>`` with scores as numbers."""
    raw = spark.read.schema(f"{id_col} {id_type}, results {RESULT_TYPE}").json(path)
    spans = F.transform(
        F.col("results"),
        lambda r: F.struct(
            r["entity_type"].alias("entity_type"),
            r["start"].alias("start"),
            r["end"].alias("end"),
            r["score"].try_cast("double").alias("score"),
            F.when(r["analysis_explanation"] != "None", r["analysis_explanation"]).alias("explanation"),
        ),
    )
    return raw.select(id_col, spans.alias("spans"))


def write_items(df: DataFrame, path: str, id_col: str, items_col: str = "items", mode: str = "errorifexists") -> None:
    """``{id, items: [{operator, entity_type, start, end, text}]}``, of either direction."""
    df.select(id_col, F.col(items_col).alias("items")).write.mode(mode).json(path)


def read_items(spark: SparkSession, path: str, id_col: str, id_type: str = "string") -> DataFrame:
    return spark.read.schema(f"{id_col} {id_type}, items {ITEM_FIELDS}").json(path)
