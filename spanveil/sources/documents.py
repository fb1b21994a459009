"""Documents: read, cut into chunks, put together, check, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions.arrays import blocks

CHUNK = 1024 * 1024


def read_texts(spark: SparkSession, path: str | list[str], stream: bool = False) -> DataFrame:
    """One document per text file: ``<name, text>``; ``path`` may be a pattern."""
    reader = spark.readStream if stream else spark.read
    texts = reader.text(path, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "")
    return texts.select(name.alias("name"), F.col("value").alias("text"))


def read_documents(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A stored corpus (parquet), only the columns asked for."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def split_chunks(df: DataFrame, id_col: str, text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """``<id, idx, chunk>`` with chunks of ``size`` code points, in one pass over each text.

    An empty text is one empty chunk, a NULL text one NULL chunk.
    """
    text = F.col(text_col)
    cut = F.when(text.isNull() | (text == ""), F.array(text)).otherwise(blocks(text, size))
    return df.select(F.col(id_col), F.posexplode(cut).alias("idx", "chunk"))


def join_chunks(chunks: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Put chunks together in the order of ``idx``; ``status`` says ``missing_chunks``,
    and the text is NULL, where one before the last is not there."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "chunk")))
    whole = F.countDistinct("idx") == F.max("idx") + 1
    text = F.array_join(F.transform(ordered, lambda c: c["chunk"]), "")
    return chunks.groupBy(id_col).agg(
        F.when(whole & (F.count("chunk") == F.count(F.lit(1))), text).alias(text_col),
        F.when(whole, "ok").otherwise("missing_chunks").alias("status"),
    )


def reconcile_chunks(sent: DataFrame, received: DataFrame, id_col: str) -> DataFrame:
    """Chunks sent and received per document, from one aggregation of both."""
    both = sent.select(id_col, F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(
        received.select(id_col, F.lit(0).alias("s"), F.lit(1).alias("r"))
    )
    counts = both.groupBy(id_col).agg(F.sum("s").alias("sent"), F.sum("r").alias("received"))
    status = F.when(F.col("received") == F.col("sent"), "ok").when(F.col("received") == 0, "not_received")
    return counts.withColumn("status", status.otherwise("incomplete"))


def missing_inputs(id_col: str, **tables: DataFrame) -> DataFrame:
    """Ids that lack one of the given inputs: ``<id, missing>``.

    Only ids are read; one aggregation over the union replaces a join per
    input.
    """
    names = list(tables)
    both = None
    for name, df in tables.items():
        flags = df.select(id_col, *[F.lit(n == name).alias(n) for n in names])
        both = flags if both is None else both.unionByName(flags)
    seen = both.groupBy(id_col).agg(*[F.max(n).alias(n) for n in names])
    absent = F.filter(
        F.array(*[F.when(~F.col(n), n) for n in names]), lambda x: x.isNotNull()
    )
    return seen.select(id_col, F.array_join(absent, ",").alias("missing")).where(F.col("missing") != "")


def write_texts(df: DataFrame, path: str, id_col: str, text_col: str, mode: str = "errorifexists") -> None:
    """Write texts with their ids as parquet."""
    df.select(id_col, text_col).write.mode(mode).parquet(path)


def export_texts(df: DataFrame, path: str, id_col: str, text_col: str, suffix: str = "") -> None:
    """Write one folder with a text file per document, for hand-over of few documents.

    Text files end with a line break; :func:`write_texts` keeps texts exactly.
    """
    named = df.select(F.concat(F.col(id_col).cast("string"), F.lit(suffix)).alias("name"), F.col(text_col).alias("value"))
    named.write.partitionBy("name").text(path)
