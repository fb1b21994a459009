"""What became of every candidate, from the pass that makes the spans."""

from dataclasses import replace

from pyspark.sql import Observation

from spanveil import EngineOptions, Pattern, analyze, analyze_options, decision_log, engine_options, observe_decisions, recognizers_for, regex_recognizer
from spanveil.operators.analyze import REASONS

TEXT = "card 4111-1111-1111-1111, card 4111-1111-1111-1112, ssn 219-09-9998, mail a.b@example.org, ring (415) 555-0132"
ENGINE = EngineOptions(
    tuple(recognizers_for("CREDIT_CARD", "US_SSN", "EMAIL_ADDRESS", "PHONE_NUMBER")),
    regex=(regex_recognizer("US_SSN", [Pattern("plain", "219-09-9998", 0.3)]),),
)


def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, "nothing"), (3, None), (4, TEXT)], "id long, text string")


def outcomes(df):
    return {(r.entity_type, r.pattern, TEXT[r.start : r.end]): (r.kept, r.reason) for r in df.collect() if r.id == 1}


def test_reasons(spark):
    options = analyze_options(score_threshold=0.45, entities="credit_card,us_ssn,phone_number")
    log = decision_log(docs(spark), "id", options, ENGINE)
    assert {r.id for r in log.collect()} == {1, 4}
    assert outcomes(log) == {
        ("CREDIT_CARD", "13 to 19 digits", "4111-1111-1111-1111"): (True, None),
        ("CREDIT_CARD", "13 to 19 digits", "4111-1111-1111-1112"): (False, "check"),
        ("US_SSN", "dashed", "219-09-9998"): (True, None),
        ("US_SSN", "plain", "219-09-9998"): (False, "score"),
        ("EMAIL_ADDRESS", "address", "a.b@example.org"): (False, "entity_type"),
        ("PHONE_NUMBER", "national", "(415) 555-0132"): (False, "score"),
    }
    relaxed = outcomes(decision_log(docs(spark), "id", None, ENGINE))
    assert relaxed["US_SSN", "plain", "219-09-9998"] == (False, "better candidate")


def test_option_makes_one_pass_for_both(spark):
    options = analyze_options(score_threshold=0.45)
    traced = replace(ENGINE, log_decision_process=True)
    assert engine_options(ENGINE, log_decision_process="1") == traced
    for with_text in (False, True):
        both = analyze(docs(spark), options, traced, with_text=with_text).orderBy("id").collect()
        plain = analyze(docs(spark), options, ENGINE, with_text=with_text).orderBy("id").collect()
        assert [(r.spans, r.status) for r in both] == [(r.spans, r.status) for r in plain]
    kept = decision_log(analyze(docs(spark), options, traced), "id").where("kept").count()
    assert kept == sum(len(r.spans) for r in plain)
    found = analyze(docs(spark), options, traced)
    plan = decision_log(found, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_counters_without_a_second_pass(spark):
    watched = Observation("decisions")
    found = observe_decisions(analyze(docs(spark), None, replace(ENGINE, log_decision_process=True)), watched)
    log = [r for r in decision_log(docs(spark), "id", None, ENGINE).collect()]
    found.select("id", "spans").write.format("noop").mode("overwrite").save()
    got = watched.get
    assert got["kept"] == sum(r.kept for r in log) > 0
    for reason in REASONS:
        assert got[reason.replace(" ", "_")] == sum(r.reason == reason for r in log)


def test_per_document_entities_and_thresholds(spark):
    df = spark.createDataFrame([(1, TEXT, ["US_SSN"], 0.2), (2, TEXT, None, 0.9)], "id long, text string, wanted array<string>, least double")
    from pyspark.sql import functions as F

    options = analyze_options(entities=F.col("wanted"), score_threshold=F.col("least"))
    traced = replace(ENGINE, log_decision_process=True)
    both = analyze(df, options, traced).orderBy("id").collect()
    plain = analyze(df, options, ENGINE).orderBy("id").collect()
    assert [r.spans for r in both] == [r.spans for r in plain]


def test_bad_java_expressions_fail_before_the_job(spark):
    import pytest

    for regex in ("(?P<n>a)", "[a", "a{2,1}"):
        bad = EngineOptions((), regex=(regex_recognizer("X", [Pattern("bad", regex, 0.5)]),))
        with pytest.raises(ValueError, match="no Java expression"):
            analyze(docs(spark), engine=bad)
