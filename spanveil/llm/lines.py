"""Lines that many documents of one host have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import SPACES, text_of


def trimmed_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)))


def normalised(text: Column) -> Column:
    """Runs of digits as one zero, so that lines with a number or a date agree."""
    return F.regexp_replace(text, "[0-9]+", "0")


def frequent_lines(docs: DataFrame, host: str, text: str, hashes, share: float, min_docs: int) -> DataFrame:
    """(host, lines): per host, hashes of the lines that stand in at least ``min_docs``
    of its documents and in more than ``share`` of them. Equal texts of a host count once.

    ``hashes(text)`` makes the array of line hashes, NULL for lines that don't
    count. Rows are reduced on the map side: a host or a line may hold a third
    of all documents. The list of a host has fewer than 1 / share times its
    mean number of lines per document, however many documents there are.
    """
    body = text_of(text)
    rows = docs.select(
        F.col(host).cast("string").alias("host"),
        F.xxhash64(body, F.length(body)).alias("content"),
        F.array_distinct(F.array_compact(hashes(body))).alias("lines"),
    )
    totals = rows.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    seen = rows.select("host", "content", F.explode("lines").alias("line")).distinct()
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    many = counts.join(totals.withColumnRenamed("host", "host_"), F.col("host").eqNullSafe(F.col("host_")))
    return many.where(F.col("n") > share * F.col("total")).groupBy("host").agg(F.collect_list("line").alias("lines"))
