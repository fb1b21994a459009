"""Streams of documents.

Analyzing and rewriting keep no state, so they append batch by batch and
need no watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spanveil.operators.anonymize import Operator
from spanveil.operators.deanonymize import deanonymize
from spanveil.plans.jobs import analyze_and_anonymize
from spanveil.plans.options import AnalyzeOptions, EngineOptions


def read_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """New parquet files of documents in a folder."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to a parquet folder, each document exactly once."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start()


def anonymize_stream(
    documents: DataFrame,
    path: str,
    checkpoint: str,
    id_col: str,
    operators: Mapping[str, Operator] | None = None,
    options: AnalyzeOptions | None = None,
    engine: EngineOptions | None = None,
    available_now: bool = True,
    text_col: str = "text",
    lang_col: str | None = None,
) -> StreamingQuery:
    """Analyze and anonymize arriving documents, each in its own language if ``lang_col`` is given."""
    done = analyze_and_anonymize(documents, id_col, operators, options, engine, text_col, lang_col)
    return write_stream(
        done.select(id_col, "anonymized_text", "spans", "items", "status"), path, checkpoint, available_now
    )


def deanonymize_stream(
    documents: DataFrame, path: str, checkpoint: str, id_col: str, keys: Mapping[str, str], available_now: bool = True
) -> StreamingQuery:
    """Restore arriving documents that carry their items."""
    done = deanonymize(documents, keys)
    return write_stream(
        done.select(id_col, "restored_text", "restored_items", "status"), path, checkpoint, available_now
    )


def anonymize_stream_with_config(
    documents: DataFrame,
    config: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    id_col: str,
    options: AnalyzeOptions | None = None,
    engine: EngineOptions | None = None,
    available_now: bool = True,
    text_col: str = "text",
    lang_col: str | None = None,
    as_of: str | None = None,
) -> StreamingQuery:
    """Like :func:`anonymize_stream`, reading the config table anew per batch.

    Every batch overwrites its own folder, so a repeated batch writes the
    same data again and nothing twice. With ``as_of``, the documents' time of
    arrival, and a config of lines that are added with their ``valid_from``,
    a batch that is repeated after later lines were added gives the same texts.
    """

    def batch(df: DataFrame, number: int) -> None:
        done = analyze_and_anonymize(df, id_col, config(), options, engine, text_col, lang_col, as_of=as_of)
        done.select(id_col, "anonymized_text", "spans", "items", "status").write.mode("overwrite").parquet(
            f"{path}/batch={number}"
        )

    writer = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
