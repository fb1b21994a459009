"""Texts, spans and items kept apart, by buckets of their id, so that they join without moving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def write_store(df: DataFrame, table: str, path: str, id_col: str, buckets: int = BUCKETS, mode: str = "errorifexists") -> DataFrame:
    """Write one row per document into ``path``, one file for each bucket of ids, sorted; gives the table.

    Stores of one corpus need the same number of buckets and the same type of
    id. It is the one shuffle in a store's life: what is added from texts to
    spans to items joins by bucket.
    """
    dealt = df.repartition(buckets, id_col)
    writer = dealt.write.format("parquet").bucketBy(buckets, id_col).sortBy(id_col).option("path", path).mode(mode)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def open_store(spark: SparkSession, table: str, path: str, id_col: str, buckets: int = BUCKETS) -> DataFrame:
    """A store that another session wrote; the catalog may not know it, its files do."""
    if not spark.catalog.tableExists(table):
        schema = spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        place = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{id_col}`) SORTED BY (`{id_col}`) INTO {int(buckets)} BUCKETS LOCATION '{place}'"
        )
    return spark.table(table)


def join_stores(texts: DataFrame, more: DataFrame, id_col: str) -> DataFrame:
    """Every row of ``texts`` with the columns of ``more`` for its id; one row per document on both sides.

    An id that ``more`` has twice is an error: which of its rows belongs to
    the text can't be told. Between stores nothing is shuffled.
    """
    others = [c for c in more.columns if c != id_col]
    row = F.struct(*others)
    named = F.concat(F.lit("more than one row for document "), F.coalesce(F.col(id_col).cast("string"), F.lit("NULL")))
    one = more.groupBy(id_col).agg(F.first(row).alias("_row"), F.count(F.lit(1)).alias("_n"))
    # the check is part of every value, so that no column is read without it
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(named).cast(more.select(row.alias("r")).schema["r"].dataType))
    found = one.select(id_col, checked.alias("_row"))
    return texts.join(found, id_col, "left").select(*[texts[c] for c in texts.columns], *[F.col(f"_row.`{c}`").alias(c) for c in others])
