"""Streams give what batches give; the driver contract holds."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from spanveil import EngineOptions, Encrypt, analyze_and_anonymize, anonymize_corpus, recognizers_for
from spanveil.sources.documents import read_texts
from spanveil.streaming import streams

ENGINE = EngineOptions(tuple(recognizers_for("EMAIL_ADDRESS", "IP_ADDRESS", "US_SSN")))
KEY = "a sixteen b. key"
SCHEMA = "doc_id long, text string"


def parts(spark, sf, folder, n=3):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    df.repartition(n).write.parquet(folder)
    return df


def test_stream_equals_batch_and_restores(spark, sf, tmp_path):
    docs = parts(spark, sf, f"{tmp_path}/in")
    ops = {"DEFAULT": Encrypt(KEY)}
    stream = streams.read_stream(spark, f"{tmp_path}/in", SCHEMA, max_files=1)
    for _ in range(2):  # a second start finds nothing new
        streams.anonymize_stream(stream, f"{tmp_path}/out", f"{tmp_path}/st", "doc_id", ops, engine=ENGINE).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = analyze_and_anonymize(docs, "doc_id", ops, engine=ENGINE).select("doc_id", "anonymized_text", "items")
    assert got.count() == docs.count()
    assert got.select(want.columns).exceptAll(want).count() == 0
    closed = streams.read_stream(spark, f"{tmp_path}/out", got.schema)
    streams.deanonymize_stream(closed, f"{tmp_path}/back", f"{tmp_path}/st2", "doc_id", {"DEFAULT": KEY}).awaitTermination()
    back = spark.read.parquet(f"{tmp_path}/back").join(docs, "doc_id")
    assert back.count() == docs.count() and back.where(F.col("restored_text") != F.col("text")).count() == 0


def test_stream_takes_up_a_new_config(spark, tmp_path):
    config = {"ops": [("EMAIL_ADDRESS", "redact", None)]}
    make = lambda: spark.createDataFrame(config["ops"], "entity_type string, type string, new_value string")
    spark.createDataFrame([(1, "to a@b.org")], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = streams.read_stream(spark, f"{tmp_path}/in", SCHEMA)

    def run():
        streams.anonymize_stream_with_config(
            stream, make, f"{tmp_path}/out", f"{tmp_path}/st", "doc_id", engine=ENGINE).awaitTermination()

    run()
    config["ops"] = [("EMAIL_ADDRESS", "replace", "[m]")]
    spark.createDataFrame([(2, "to c@d.org")], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = {r.doc_id: r.anonymized_text for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: "to ", 2: "to [m]"}


def test_text_files_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "n.txt").write_text("mail a@b.org\nnow")
    docs = read_texts(spark, str(tmp_path / "in"), stream=True)
    streams.anonymize_stream(docs, f"{tmp_path}/out", f"{tmp_path}/st", "name", engine=ENGINE).awaitTermination()
    row = spark.read.parquet(f"{tmp_path}/out").first()
    assert (row.name, row.anonymized_text) == ("n", "mail <EMAIL_ADDRESS>\nnow")


def test_corpus_job(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    summary = anonymize_corpus(df, f"{tmp_path}/out", "doc_id", "lang", engine=ENGINE)
    spans = spark.read.parquet(f"{tmp_path}/out").agg(F.sum(F.size("spans"))).first()[0]
    assert summary.where("entity_type = 'ALL' and lang is null").first().spans == spans


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_repeated_batch_gets_the_config_of_its_time(spark, tmp_path):
    kind = "entity_type string, type string, new_value string, valid_from string, seq int"
    config = f"{tmp_path}/config"

    def add(seq, day, value, entity="EMAIL_ADDRESS"):
        spark.createDataFrame([(entity, "replace", value, day, seq)], kind).write.mode("append").parquet(config)

    rows = [(1, "a@b.org", "2024-02-01"), (2, "a@b.org 10.0.0.1", "2024-06-01"), (3, "a@b.org", "2023-06-01"), (4, "a@b.org", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, day string").withColumn("at", F.col("day").cast("timestamp")).drop("day")
    df.write.parquet(f"{tmp_path}/in")
    engine = EngineOptions(tuple(recognizers_for("EMAIL_ADDRESS", "IP_ADDRESS")))

    def run(name):
        streams.anonymize_stream_with_config(
            streams.read_stream(spark, f"{tmp_path}/in", df.schema), lambda: spark.read.parquet(config), f"{tmp_path}/{name}",
            f"{tmp_path}/{name}-state", "doc_id", engine=engine, as_of="at",
        ).awaitTermination()
        return {r.doc_id: r.anonymized_text for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}

    add(1, "2024-01-01", "[one]")
    add(2, "2024-05-01", "[two]")
    add(3, "2024-05-01", "[two, mended]")
    add(4, "2024-04-01", "[rest]", "DEFAULT")
    first = run("a")
    assert first == {1: "[one]", 2: "[two, mended] [rest]", 3: "<EMAIL_ADDRESS>", 4: "<EMAIL_ADDRESS>"}
    add(5, "2024-07-01", "[three]")
    assert run("b") == first
