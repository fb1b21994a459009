"""Stores by bucket: joins without a shuffle, repeated ids refused."""

import uuid

import pytest

from spanveil import Encrypt, EngineOptions, analyze_and_anonymize, deanonymize, recognizers_for
from spanveil.operators.deanonymize import attach_items
from spanveil.plans import stores

KEY = "0123456789abcdef"


def name():
    return f"t_{uuid.uuid4().hex}"


def test_texts_and_items_join_where_they_lie(spark, tmp_path):
    df = spark.createDataFrame([(k, f"mail a{k}@b.org") for k in range(200)], "id long, text string")
    done = analyze_and_anonymize(df, "id", {"DEFAULT": Encrypt(KEY)}, engine=EngineOptions(tuple(recognizers_for("EMAIL_ADDRESS"))))
    texts, items = (f"{tmp_path}/{x}" for x in ("texts", "items"))
    stores.write_store(done.select("id", "anonymized_text"), name(), texts, "id", 4)
    stores.write_store(done.where("id < 150").select("id", "items"), name(), items, "id", 4)
    # as another session would find them
    left, right = (stores.open_store(spark, name(), p, "id", 4) for p in (texts, items))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach_items(left, right, "id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        opened = {r.id: (r.restored_text, r.status) for r in deanonymize(joined, {"EMAIL_ADDRESS": KEY}).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert opened == {k: (f"mail a{k}@b.org", "ok") if k < 150 else (None, "missing_items") for k in range(200)}


def test_repeated_ids_are_refused(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    items = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (2, "z", None)], "id long, v string, w int")
    with pytest.raises(Exception, match="more than one row for document 2"):
        attach_items(texts, items, "id").select("w").collect()
    got = attach_items(texts, items.where("id = 1"), "id").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "x", 1), (2, "b", None, None)]
