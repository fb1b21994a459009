"""Queries of the driver file on texts where values touch or overlap, against their SQL."""

from collections import Counter

import duckdb

import __spark_entry__ as entry

TEXTS = [
    (1, "4451718024887799 27.65.93.188 end"),  # the card pattern runs into the IP and fails Luhn
    (2, "mail x@10.1.2.3.example now"),  # an IP inside an e-mail's domain
    (3, "call (555) 123-4567 or a@b.org"),
]


def tables(spark, tmp_path):
    rows = [(i, t, "en", "web", len(t)) for i, t in TEXTS]
    spark.createDataFrame(rows, entry.DOC_SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def same_as_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    theirs = Counter(tuple(sorted(zip(names, r))) for r in got.fetchall())
    mine = Counter(tuple(sorted(r.asDict().items())) for r in entry.queries()[name](spark, sf).collect())
    assert mine == theirs


def test_residual_of_values_next_to_replaced_ones(spark, tmp_path):
    same_as_sql(spark, tables(spark, tmp_path), "residual_check")


def test_overlapping_values_all_count(spark, tmp_path):
    same_as_sql(spark, tables(spark, tmp_path), "stat_preservation")
