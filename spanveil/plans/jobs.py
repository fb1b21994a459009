"""Whole jobs: analyze, rewrite, store, report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from spanveil.operators.analyze import analyze
from spanveil.operators.anonymize import Operator, anonymize
from spanveil.operators.corpus import entity_summary
from spanveil.plans.options import AnalyzeOptions, EngineOptions


def analyze_and_anonymize(
    df: DataFrame,
    id_col: str,
    operators: Mapping[str, Operator] | DataFrame | None = None,
    options: AnalyzeOptions | None = None,
    engine: EngineOptions | None = None,
    text_col: str = "text",
    lang_col: str | None = None,
    with_text: bool = False,
    as_of: str | None = None,
) -> DataFrame:
    """Spans, new text and items side by side; a narrow plan for batch and stream."""
    found = analyze(df, options, engine, text_col, lang_col, with_text=with_text)
    return anonymize(found, operators, text_col, id_col=id_col, as_of=as_of)


def anonymize_corpus(
    df: DataFrame,
    path: str,
    id_col: str,
    by: str,
    operators: Mapping[str, Operator] | DataFrame | None = None,
    options: AnalyzeOptions | None = None,
    engine: EngineOptions | None = None,
    text_col: str = "text",
    lang_col: str | None = None,
    mode: str = "errorifexists",
) -> DataFrame:
    """Anonymize a corpus into ``path`` and summarise what was found.

    The texts are read and rewritten once. Spans, items and new texts are
    written as one table; the summary reads two narrow columns of it.
    """
    done = analyze_and_anonymize(df, id_col, operators, options, engine, text_col, lang_col)
    kept = dict.fromkeys([id_col, by, "anonymized_text", "spans", "items", "status"])
    done.select(*kept).write.mode(mode).parquet(path)
    return entity_summary(df.sparkSession.read.parquet(path), by)
