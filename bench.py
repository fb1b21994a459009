"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up; the value is the median of the timed runs.
Results go to Spark's noop sink, so that every column is computed and nothing
but the query is measured.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanveil import (  # noqa: E402
    Encrypt,
    EngineOptions,
    Hash,
    Mask,
    analyze,
    analyze_and_anonymize,
    deanonymize,
    deny_list_recognizer,
    gazetteer_spans,
    recognizers_for,
)
from spanveil.operators import corpus  # noqa: E402
from spanveil.plans.tables import stored  # noqa: E402
from spanveil.sources.documents import read_documents  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
MAIN = EngineOptions(tuple(recognizers_for("EMAIL_ADDRESS", "IP_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD")))
KEY = "a sixteen b. key"


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    path = f"{SF_DIR}/documents.parquet"

    def docs(*more: str):
        # the test corpus is one file with one row group; a real one is not
        return read_documents(spark, path, ["doc_id", "text", *more]).repartition(int(CPUS))

    sealed = stored(
        analyze_and_anonymize(docs(), "doc_id", {"DEFAULT": Encrypt(KEY)}, engine=MAIN).select(
            "doc_id", "anonymized_text", "items"
        )
    )
    words = spark.createDataFrame(
        [("the", "ARTICLE"), ("and the", "PAIR"), ("of the", "PAIR"), ("und", "JOINER")], "phrase string, entity_type string"
    )

    def rewritten(operators):
        return lambda: analyze_and_anonymize(docs(), "doc_id", operators, engine=MAIN).select(
            "doc_id", "anonymized_text", "items"
        )

    def found(*more: str):
        return analyze(docs(*more), engine=MAIN, with_text=True)

    queries = {
        "scan_only": lambda: docs(),
        "analyze_all_19_types": lambda: analyze(docs()).select("doc_id", "spans"),
        "analyze_4_types": lambda: analyze(docs(), engine=MAIN).select("doc_id", "spans"),
        "deny_list": lambda: analyze(
            docs(), engine=EngineOptions((), deny_list=(deny_list_recognizer("ARTICLE", "the,The,of"),))
        ).select("doc_id", "spans"),
        "anonymize_default": rewritten({}),
        "anonymize_mask": rewritten({"DEFAULT": Mask("*", 4)}),
        "anonymize_sha256": rewritten({"DEFAULT": Hash("sha256")}),
        "anonymize_encrypt": rewritten({"DEFAULT": Encrypt(KEY)}),
        "deanonymize": lambda: deanonymize(sealed, {"DEFAULT": KEY}).select("doc_id", "restored_text", "restored_items"),
        "entity_summary": lambda: corpus.entity_summary(found("lang"), "lang"),
        "link_values": lambda: corpus.link_values(corpus.doc_values(found(), "doc_id"), "doc_id"),
        "link_documents": lambda: corpus.link_documents(stored(corpus.doc_values(found(), "doc_id")), "doc_id"),
        "gazetteer": lambda: gazetteer_spans(docs(), words, "doc_id"),
    }
    wanted = sys.argv[1:] or list(queries)
    times = {}
    for name in wanted:
        seconds = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            queries[name]().write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seconds[1:]), 3)
    size = docs().agg(F.count(F.lit(1)), F.sum(F.octet_length("text")) / 1e6).first()
    rates = {
        q: {"docs_per_sec": round(size[0] / t), "mb_per_sec": round(size[1] / t, 1)}
        for q, t in times.items() if q.startswith(("analyze", "anonymize", "deanonymize"))
    }
    spark.stop()
    print(json.dumps({
        "metric": "total seconds over headline queries (median of warm runs)",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1],
        "cpus": int(CPUS), "documents": size[0], "megabytes": round(size[1], 1), "rates": rates,
    }))


if __name__ == "__main__":
    main()
