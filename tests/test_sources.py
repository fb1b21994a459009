"""Files in and out, chunks, configurations, missing inputs."""

import json

import pytest
from pyspark.sql import functions as F

from spanveil import Encrypt, EngineOptions, Hash, Mask, Redact, Replace, analyze, anonymize, deanonymize, recognizers_for
from spanveil.plans.tables import stored
from spanveil.sources import configs, documents, results

TEXT = "Emma's new social security card: 123-45-6789.  A driver license today is 7654321B."
KEY = "MDEyMzQ1Njc4OWFiY2RlZg=="


def write(folder, files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_text_files_whole(spark, tmp_path):
    path = write(tmp_path / "in", {"one.txt": "a\nb\n\n", "two.v1.txt": "é😀", "three.txt": "x\r\ny"})
    got = {r.name: r.text for r in documents.read_texts(spark, path).collect()}
    assert got == {"one": "a\nb\n\n", "two.v1": "é😀", "three": "x\r\ny"}


def test_export_and_store(spark, tmp_path):
    df = spark.createDataFrame([("d1", "a\nb"), ("d2", "é")], "name string, text string")
    documents.export_texts(df, str(tmp_path / "out"), "name", "text", "-anonymized")
    back = documents.read_texts(spark, str(tmp_path / "out" / "*"))
    assert {r.text for r in back.collect()} == {"a\nb\n", "é\n"}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["name=d1-anonymized", "name=d2-anonymized"]
    documents.write_texts(df, str(tmp_path / "p"), "name", "text")
    assert documents.read_documents(spark, str(tmp_path / "p"), ["name"]).count() == 2


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_chunks(spark, size):
    texts = ["", "a", "ab😀é" * 50, "x\n\ny\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    chunks = documents.split_chunks(df, "id", size=size)
    assert chunks.where(F.length("chunk") > size).count() == 0
    back = {r.id: r.text for r in documents.join_chunks(chunks, "id").collect()}
    assert back == dict(enumerate(texts))
    got = documents.reconcile_chunks(chunks, chunks.where("id <> 1 and (id <> 2 or idx > 0)"), "id")
    status = {r.id: r.status for r in got.collect()}
    assert status == {0: "ok", 1: "not_received", 2: "incomplete" if size < 200 else "not_received", 3: "ok", 4: "ok"}
    gap = documents.join_chunks(chunks.where("id = 2 and idx <> 1"), "id").first()
    assert size > 100 or (gap.text, gap.status) == (None, "missing_chunks")


def test_missing_inputs(spark):
    a, b, c = (spark.createDataFrame([(i,) for i in ids], "id long") for ids in ([1, 2, 3], [2, 3, 3], [3, 4]))
    got = documents.missing_inputs("id", text=a, spans=b, keys=c).collect()
    assert {r.id: r.missing for r in got} == {1: "spans,keys", 2: "keys", 4: "text,spans"}


def test_results_and_items(spark, tmp_path):
    df = analyze(spark.createDataFrame([("d", TEXT)], "name string, text string"))
    results.write_results(df.coalesce(1), str(tmp_path / "r"), "name")
    line = json.loads(next((tmp_path / "r").glob("part*.json")).read_text())
    assert line["results"][2] == {
        "start": 73, "end": 81, "score": "0.65", "entity_type": "US_DRIVER_LICENSE", "analysis_explanation": "None"}
    spans = results.read_results(spark, str(tmp_path / "r"), "name")
    assert spans.first().spans == df.first().spans
    done = anonymize(spans.join(df.select("name", "text"), "name"), {"PERSON": Encrypt(KEY)}, id_col="name")
    results.write_items(done, str(tmp_path / "i"), "name")
    stored_items = results.read_items(spark, str(tmp_path / "i"), "name")
    back = deanonymize(done.select("name", "anonymized_text").join(stored_items, "name"), {"PERSON": KEY}).first()
    assert back.restored_text.startswith("Emma's") and back.restored_items[0].text == "Emma"
    results.write_items(
        deanonymize(done, {"PERSON": KEY}), str(tmp_path / "d"), "name", items_col="restored_items")
    assert results.read_items(spark, str(tmp_path / "d"), "name").first()["items"][0].operator == "decrypt"


def test_operator_config_round_trip(spark, tmp_path):
    config = {"PERSON": Encrypt(KEY), "A": Replace('say "no"'), "B": Mask("*", 4, True), "C": Hash("md5"), "D": Redact()}
    for entity, op in (("B", Mask("#", 1)), ("A", Replace('say "yes"'))):
        config = configs.upsert_operator(config, entity, op)
    configs.write_operator_config(spark, config, str(tmp_path / "c"))
    table = configs.read_operator_config(spark, str(tmp_path / "c"))
    assert configs.load_operators(table) == config
    assert {r.key for r in configs.show_config(table).collect()} == {None, "***"}
    configs.write_operator_config(spark, {}, str(tmp_path / "c"))
    assert configs.read_operator_config(spark, str(tmp_path / "c")).count() == 0
    configs.write_operator_config(spark, {"PERSON": Encrypt(KEY)}, str(tmp_path / "k"), decrypt=True)
    keys = configs.read_operator_config(spark, str(tmp_path / "k"))
    df = anonymize(analyze(spark.createDataFrame([(1, TEXT)], "id long, text string")), table.limit(0), id_col="id")
    assert df.first().anonymized_text.startswith("<PERSON>")
    assert keys.first().type == "decrypt"


def test_last_config_line_wins_on_the_exact_name(spark, tmp_path):
    line = lambda e, v: json.dumps({"entity_type": e, "params": json.dumps({"type": "replace", "new_value": v})})
    path = write(tmp_path / "c", {"f.txt": "\n".join([line("PERSON", "1"), line("PERSON_X", "2"), line("PERSON", "3"), "{bad"])})
    table = configs.read_operator_config(spark, path)
    assert table.where("status = 'malformed'").count() == 1
    latest = configs.latest_config(table.where("status = 'ok'"))
    assert {r.entity_type: r.new_value for r in latest.collect()} == {"PERSON": "3", "PERSON_X": "2"}


def test_engine_and_analyze_options(spark, tmp_path):
    regex = {"supported_entity": "ZIP", "pattern": [{"name_pattern": "z", "regex": r"\b\d{5}\b", "score": "0.1"}], "context": ""}
    good = {"uuidClient": "a", "regex": json.dumps(regex), "default_score_threshold": "0.05",
            "deny_list": json.dumps({"supported_entity": ["T"], "deny_list": ["fig.,No."]}), "supported_languages": "EN"}
    broken = {"uuidClient": "b", "regex": '{ "supported_entity": "ZIP", "pattern": [{\'name_pattern\': \'z\'}], "context": ""}'}
    uneven = {"uuidClient": "c", "deny_list": json.dumps({"supported_entity": ["T"], "deny_list": []})}
    path = write(tmp_path / "e", {f"{o['uuidClient']}.json": json.dumps(o, indent=1) for o in (good, broken, uneven)})
    table = configs.read_engine_options(spark, path)
    assert {r.uuidClient: r.status for r in table.collect()} == {"a": "ok", "b": "malformed", "c": "malformed"}
    engine = configs.load_engine_options(table, "a")
    assert [r.entity_type for r in (*engine.regex, *engine.deny_list)] == ["ZIP", "T"]
    assert (engine.default_score_threshold, engine.supported_languages) == (0.05, ("en",))
    for request in ("b", "missing"):
        with pytest.raises(ValueError):
            configs.load_engine_options(table, request)
    path = write(tmp_path / "a", {"a.json": json.dumps(
        {"uuidClient": "a", "language": "en", "score_threshold": "0.1", "entities": "zip, person", "return_decision_process": "1"}, indent=1)})
    options = configs.load_analyze_options(configs.read_analyze_options(spark, path), "a")
    assert (options.entities, options.score_threshold, options.return_decision_process) == (("ZIP", "PERSON"), 0.1, True)
    got = analyze(spark.createDataFrame([(1, "Emma at 60614")], "id long, text string"), options, engine).first().spans
    assert [(s.entity_type, s.score) for s in got] == [("PERSON", 0.85), ("ZIP", 0.1)]
    path = write(tmp_path / "n", {"n.json": json.dumps({"uuidClient": "n", "entities": "none"})})
    assert configs.load_analyze_options(configs.read_analyze_options(spark, path), "n").entities is None


def test_stored_tables_are_read_back(spark):
    df = stored(spark.range(10).withColumn("r", F.rand()))
    assert df.inputFiles() and df.collect() == df.collect()


def test_only_needed_columns_are_read(spark, sf):
    df = documents.read_documents(spark, f"{sf}/documents.parquet", ["doc_id", "text"])
    plan = anonymize(analyze(df, engine=EngineOptions(tuple(recognizers_for("US_SSN"))))).select("doc_id", "anonymized_text")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan._jdf.queryExecution().executedPlan().toString()


def test_an_appended_config_line_wins_and_a_bad_one_ends_nothing(spark, tmp_path):
    import time

    path = str(tmp_path / "config")
    line = lambda params: spark.createDataFrame([(f'{{"entity_type": "X", "params": "{params}"}}',)], "value string")
    say = lambda v: '{\\"type\\": \\"replace\\", \\"new_value\\": \\"' + v + '\\"}'
    line(say("old")).coalesce(1).write.text(path)
    time.sleep(1.1)
    line(say("a much longer new value")).coalesce(1).write.mode("append").text(path)
    time.sleep(1.1)
    spark.createDataFrame([("not json",)], "value string").write.mode("append").text(path)
    config = configs.read_operator_config(spark, path)
    assert {r.status for r in config.collect()} == {"ok", "malformed"}
    assert [(r.entity_type, r.new_value) for r in configs.latest_config(config).collect()] == [("X", "a much longer new value")]
    df = spark.createDataFrame([(1, "abc", [("X", 0, 1, 1.0)])], "id long, text string, spans array<struct<entity_type string, start int, end int, score double>>")
    assert anonymize(df, config, id_col="id").first().anonymized_text == "a much longer new valuebc"
