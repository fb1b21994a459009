"""Spans: the worked examples, offsets, context, thresholds, checks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanveil import (
    EngineOptions,
    Pattern,
    analyze,
    analyze_options,
    decision_log,
    deny_list_recognizer,
    engine_options,
    recognizers_for,
    regex_recognizer,
    span_rows,
)
from spanveil.functions import checks
from spanveil.functions.spans import last_words, regex_matches
from spanveil.operators.analyze import combine_spans
from spanveil.operators.predefined import PREDEFINED, SUPPORTED_ENTITIES
from spanveil.operators.recognizers import create_patterns, deny_list_recognizers, prune

SSN_TEXT = "Emma's new social security card: 123-45-6789.  A driver license today is 7654321B."


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def found(spark, text, engine=None, options=None):
    df = analyze(texts(spark, text), options, engine, with_text=True)
    return [(s.entity_type, s.start, s.end, s.score) for s in df.first().spans]


def test_names_numbers_and_licences(spark):
    assert found(spark, SSN_TEXT) == [
        ("PERSON", 0, 4, 0.85),
        ("US_SSN", 33, 44, 0.85),
        ("US_DRIVER_LICENSE", 73, 81, 0.65),
    ]


def test_deny_list_with_dots(spark):
    engine = engine_options(deny_list=[deny_list_recognizer("UNIT", "approx.,fig.,No.,No")])
    text = "See fig. 4 or No. 7, approx. at Mr. Gray's, No more"
    assert found(spark, text, engine) == [
        ("UNIT", 4, 8, 1.0), ("UNIT", 14, 17, 1.0), ("UNIT", 21, 28, 1.0), ("PERSON", 36, 42, 0.85), ("UNIT", 44, 46, 1.0)
    ]


def test_regex_with_context(spark):
    spec = (
        r'{"supported_entity": "LAB_SAMPLE", "pattern": [{"name_pattern": "sample number", '
        r'"regex": "\\bQ[0-9]{3}/[0-9]{2}\\b", "score": "0.03"}], "context": "sample,specimen"}'
    )
    engine = engine_options(regex=spec)
    assert found(spark, "the specimen was Q417/22 then", engine) == [("LAB_SAMPLE", 17, 24, 0.4)]
    assert found(spark, "route Q417/22", engine) == [("LAB_SAMPLE", 6, 13, 0.03)]


def test_two_deny_lists(spark):
    lists = deny_list_recognizers(["COLOUR", "METAL"], ["red,dark red,Red", "tin,iron,pig iron"])
    engine = EngineOptions((), deny_list=tuple(lists))
    assert found(spark, "Red tin, dark red pig iron", engine) == [
        ("COLOUR", 0, 3, 1.0), ("METAL", 4, 7, 1.0), ("COLOUR", 9, 17, 1.0), ("METAL", 18, 26, 1.0)
    ]
    assert found(spark, "Redder tint, ironing", engine) == []


def test_offsets_are_code_points(spark):
    assert found(spark, "x 😀 é 219-09-9998") == [("US_SSN", 6, 17, 0.5)]
    assert found(spark, "219-09-9998") == [("US_SSN", 0, 11, 0.5)]
    assert found(spark, "é219-09-9998") == []


def test_missing_and_empty_texts(spark):
    rows = analyze(texts(spark, None, "")).orderBy("id").collect()
    assert [(r.status, r.spans) for r in rows] == [("missing_text", []), ("ok", [])]


# value, entity type, whether it is one
VALUES = [
    ("4111-1111-1111-1111", "CREDIT_CARD", True),
    ("4111-1111-1111-1112", "CREDIT_CARD", False),
    ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "CRYPTO", True),
    ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", "CRYPTO", False),
    ("3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "CRYPTO", True),
    ("2024-02-29", "DATE_TIME", True),
    ("2023-02-29", "DATE_TIME", False),
    ("31/12/1999", "DATE_TIME", True),
    ("12/31/1999", "DATE_TIME", True),
    ("31/13/1999", "DATE_TIME", False),
    ("September 18, 2020", "DATE_TIME", True),
    ("18th of September 2020", "DATE_TIME", True),
    ("shop.example.com", "DOMAIN_NAME", True),
    ("shop.example.nothing", "DOMAIN_NAME", False),
    ("a.b+c@mail.example.org", "EMAIL_ADDRESS", True),
    ("a.b at mail.example.org", "EMAIL_ADDRESS", False),
    ("GB82WEST12345698765432", "IBAN_CODE", True),
    ("GB82WEST12345698765433", "IBAN_CODE", False),
    ("DE89 3704 0044 0532 0130 00", "IBAN_CODE", True),
    ("192.168.0.1", "IP_ADDRESS", True),
    ("192.168.0.256", "IP_ADDRESS", False),
    ("2001:db8::1", "IP_ADDRESS", True),
    ("2001:db8:0:0:0:0:0:1", "IP_ADDRESS", True),
    ("10:20:30", "IP_ADDRESS", False),
    ("New York", "LOCATION", True),
    ("Yorkish", "LOCATION", False),
    ("AB1234563", "MEDICAL_LICENSE", True),
    ("AB1234567", "MEDICAL_LICENSE", False),
    ("Catholic", "NRP", True),
    ("catholicity", "NRP", False),
    ("Mr. Oddname", "PERSON", True),
    ("oddname", "PERSON", False),
    ("(646) 555-0187", "PHONE_NUMBER", True),
    ("212-555-1234", "PHONE_NUMBER", True),
    ("+44 20 7946 0958", "PHONE_NUMBER", True),
    ("555-1234", "PHONE_NUMBER", False),
    ("S1234567D", "SG_NRIC_FIN", True),
    ("S1234567A", "SG_NRIC_FIN", False),
    ("943 476 5919", "UK_NHS", True),
    ("943 476 5918", "UK_NHS", False),
    ("880012345678", "US_BANK_NUMBER", True),
    ("8800123", "US_BANK_NUMBER", False),
    ("1234567A", "US_DRIVER_LICENSE", True),
    ("123456A", "US_DRIVER_LICENSE", False),
    ("912-78-1234", "US_ITIN", True),
    ("912-48-1234", "US_ITIN", False),
    ("340007237", "US_PASSPORT", True),
    ("34000723", "US_PASSPORT", False),
    ("219-09-9998", "US_SSN", True),
    ("000-09-9998", "US_SSN", False),
    ("666-09-9998", "US_SSN", False),
    ("219-00-9998", "US_SSN", False),
]


def test_each_entity_type_at_each_place(spark):
    """Alone, at both ends, after an emoji and after accented letters."""
    shapes = ["{}", "{} then", "see {}", "😀 {} x", "été {}, x", "«{}»"]
    rows = [
        (i, e, ok, shape.format(v))
        for i, (v, e, ok) in enumerate(VALUES)
        for shape in shapes
    ]
    df = spark.createDataFrame(rows, "i int, entity string, ok boolean, text string")
    got = analyze(df, with_text=True).select(
        "i", "entity", "ok", "text",
        F.filter("spans", lambda s: s["entity_type"] == F.col("entity")).alias("spans"),
    )
    assert {e for _, e, _ in VALUES} == set(SUPPORTED_ENTITIES)
    for r in got.collect():
        value = VALUES[r.i][0]
        if r.ok:
            tail = value.removeprefix("Mr. ")
            assert (r.text.index(tail), tail) in [(s.start, s.text) for s in r.spans], r
        else:
            assert r.spans == [], r


def test_phone_prefixes(spark):
    """The leading 1 belongs to the number, unless it is the end of another one."""
    engine = EngineOptions(tuple(recognizers_for("PHONE_NUMBER")))
    for text, start in (
        ("a +1 (646) 555-0187", 2), ("a 1-(646) 555-0187", 2), ("a 21 (646) 555-0187", 5), ("x+1 (646) 555-0187", 2),
        ("(646) 555-0187", 0), ("+1 (646) 555-0187", 0), ("1 (646) 555-0187", 0), ("2+ (646) 555-0187", 3),
    ):
        assert [s[1:3] for s in found(spark, text, engine)] == [(start, len(text))], text


def test_context_lifts_scores(spark):
    for text, score in (("call me at (646) 555-0187", 0.75), ("(646) 555-0187", 0.4), ("CALL (646) 555-0187", 0.75)):
        assert found(spark, text, EngineOptions(tuple(recognizers_for("PHONE_NUMBER"))))[0][3] == score


def test_context_is_the_last_five_words(spark):
    near, far = "bank a b c d 12345678", "bank a b c d e 12345678"
    engine = EngineOptions(tuple(recognizers_for("US_BANK_NUMBER")))
    assert found(spark, near, engine)[0][3] == 0.4
    assert found(spark, far, engine)[0][3] == 0.05


def test_context_across_earlier_matches(spark):
    """Each match sees the words before it, matches included."""
    engine = EngineOptions(tuple(recognizers_for("US_BANK_NUMBER")))
    text = "account 11111111 22222222 33333333 44444444 55555555 66666666"
    assert [s[3] for s in found(spark, text, engine)] == [0.4] * 5 + [0.05]


def test_context_behind_matches_without_words(spark):
    dots = regex_recognizer("DOTS", [Pattern("dots", r"[.]{3}", 0.1)], "stop")
    text = "stop " + "... " * 12
    got = found(spark, text, EngineOptions((), regex=(dots,)))
    assert [s[3] for s in got] == [0.45] * 12


def test_last_words(spark):
    df = spark.createDataFrame([("a bc, d! e f g ",), ("a",), ("",), ("--",)], "t string")
    assert [r.w for r in df.select(F.expr(last_words("t", 3)).alias("w")).collect()] == ["e f g ", "a", "", ""]


def test_threshold_is_inclusive_and_falls_back(spark):
    assert [s[0] for s in found(spark, SSN_TEXT, None, analyze_options(score_threshold="0.65"))] == [
        "PERSON", "US_SSN", "US_DRIVER_LICENSE"]
    assert [s[0] for s in found(spark, SSN_TEXT, None, analyze_options(score_threshold=0.66))] == ["PERSON", "US_SSN"]
    assert [s[0] for s in found(spark, SSN_TEXT, engine_options(default_score_threshold="0.7"))] == ["PERSON", "US_SSN"]


def test_entities_and_languages(spark):
    assert [s[0] for s in found(spark, SSN_TEXT, None, analyze_options(entities="person, us_ssn"))] == ["PERSON", "US_SSN"]
    assert len(found(spark, SSN_TEXT, None, analyze_options(entities="None"))) == 3
    row = analyze(texts(spark, SSN_TEXT), analyze_options(language="fr"), engine_options(supported_languages="EN,de")).first()
    assert (row.status, row.spans) == ("unsupported_language", [])


def test_recognizer_languages(spark):
    word = regex_recognizer("W", [Pattern("w", "[a-z]+", 0.5)], languages=["de"])
    df = spark.createDataFrame([(1, "de", "ja"), (2, "en", "no")], "id long, lang string, text string")
    got = analyze(df, engine=EngineOptions((), regex=(word,)), lang_col="lang").orderBy("id").collect()
    assert [len(r.spans) for r in got] == [1, 0]
    assert found(spark, "ja", EngineOptions((), regex=(word,))) == []


def test_static_pruning():
    kept = prune(PREDEFINED, threshold=0.5)
    assert {r.entity_type for r, _ in kept}.isdisjoint({"US_BANK_NUMBER", "US_PASSPORT"})
    assert "US_DRIVER_LICENSE" in {r.entity_type for r, _ in kept}
    assert {r.entity_type for r, _ in prune(PREDEFINED, ["PERSON"])} == {"PERSON"}


def test_ad_hoc_recognizers_and_explanations(spark):
    extra = regex_recognizer("CODE", [Pattern('the "code"', "X[0-9]+", 0.3)], name="mine")
    options = analyze_options(return_decision_process="true", ad_hoc_recognizers=[extra], entities="CODE")
    spans = analyze(texts(spark, "an X12"), options).first().spans
    assert [s.explanation for s in spans] == ["recognizer 'mine', pattern 'the 'code'', score 0.30"]


def test_same_place_keeps_the_best_score(spark):
    two = regex_recognizer("N", [Pattern("low", "[0-9]{4}", 0.2), Pattern("high", "1[0-9]{3}", 0.7)])
    assert found(spark, "1234 5678", EngineOptions((), regex=(two,))) == [("N", 0, 4, 0.7), ("N", 5, 9, 0.2)]
    log = decision_log(texts(spark, "1234"), "id", analyze_options(correlation_id="c"), EngineOptions((), regex=(two,)))
    assert sorted((r.pattern, r.kept, r.correlation_id) for r in log.collect()) == [("high", True, "c"), ("low", False, "c")]


def test_combine_spans(spark):
    span = "struct<entity_type:string,start:int,end:int,score:double,explanation:string>"
    df = spark.createDataFrame(
        [([("A", 0, 2, 0.5, None)], [("A", 0, 2, 0.9, "m"), ("B", 0, 2, 0.1, None)])], f"a array<{span}>, b array<{span}>")
    got = df.select(combine_spans(F.col("a"), F.col("b")).alias("s")).first().s
    assert [tuple(s) for s in got] == [("A", 0, 2, 0.9, "m"), ("B", 0, 2, 0.1, None)]


@pytest.mark.parametrize("count", [0, 1, 31, 32, 33, 1000, 5000])
def test_many_matches_against_python(spark, count):
    """Running totals over one block, several blocks and none."""
    text = " ".join(f"é{'a' * (i % 7)}{i}" for i in range(count))
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(regex_matches(F.col("text"), "[0-9]+").alias("m")).first().m
    assert [(m.start, m.end, m.value) for m in got] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)]


def test_offsets_over_the_corpus(spark, sf):
    """Every span covers its text, in every document."""
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    spans = span_rows(analyze(df, with_text=True).withColumnRenamed("text", "whole"), "doc_id", "whole")
    assert spans.count() > 0
    assert spans.where(F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text")).count() == 0


def test_plan_is_narrow_and_detects_once(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = span_rows(analyze(df, engine=EngineOptions(tuple(recognizers_for("EMAIL_ADDRESS")))), "doc_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("RLIKE") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("make", [
    lambda: Pattern("p", "a*", 0.5),
    lambda: Pattern("p", "", 0.5),
    lambda: Pattern("p", "a", 1.5),
    lambda: create_patterns(["a"], ["a", "b"], [0.1]),
    lambda: deny_list_recognizers(["A", "B"], ["x"]),
    lambda: deny_list_recognizer("A", " , "),
    lambda: recognizers_for("NO_SUCH"),
    lambda: analyze_options(nothing="x"),
    lambda: engine_options(default_score_threshold="2"),
    lambda: engine_options(log_decision_process="perhaps"),
])
def test_bad_settings_fail_early(make):
    with pytest.raises(ValueError):
        make()


def test_wallet_check_against_hashlib(spark):
    import hashlib
    import random

    alphabet = checks.BASE58
    rng = random.Random(7)

    def address(version):
        raw = bytes([version]) + rng.randbytes(20)
        raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
        n, out = int.from_bytes(raw, "big"), ""
        while n:
            n, r = divmod(n, 58)
            out = alphabet[r] + out
        return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out

    good = [address(v) for v in (0, 5) for _ in range(20)]
    bad = [a[:-1] + ("2" if a[-1] != "2" else "3") for a in good]
    df = spark.createDataFrame([(a, True) for a in good] + [(a, False) for a in bad], "a string, ok boolean")
    assert df.where(checks.wallet(F.col("a")) != F.col("ok")).count() == 0


@pytest.mark.parametrize("regex", ["(?=a)|12", "[0-9]*", "12|(?=q)", "(?=abc)|c|12", "x*"])
def test_zero_width_matches_shift_no_offset(spark, regex):
    rng = random.Random(3)
    texts = ["abc abc 12 x", "12", "", "a", "qq12q", *("".join(rng.choice("abc12 qx") for _ in range(12)) for _ in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: [(m.start, m.end, m.value) for m in r.m] for r in df.select("id", regex_matches(F.col("text"), regex).alias("m")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == [(m.start(), m.end(), m.group()) for m in re.finditer(regex, text) if m.group()], text


def test_addresses_of_any_length(spark):
    texts = ["x" * 100 + "@ex.org", "a@" + "b" * 70 + "." + "c" * 70, "a@" + "b." * 20_000 + "com", "see a@b.c, and é.x@y.zz."]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    engine = EngineOptions(recognizers=tuple(recognizers_for("EMAIL_ADDRESS")))
    got = {r.id: [(s.start, s.end) for s in r.spans] for r in analyze(df, engine=engine).collect()}
    assert [got[i] for i in range(3)] == [[(0, len(t))] for t in texts[:3]]
    assert [texts[3][a:b] for a, b in got[3]] == ["a@b.c", "é.x@y.zz"]


def test_whole_names_and_long_deny_lists(spark):
    df = spark.createDataFrame([(1, "Mr. Kate McDonald-Smith Ann Lee O'Neil went; t299 t3")], "id long, text string")
    engine = EngineOptions(recognizers=(*recognizers_for("PERSON"), deny_list_recognizer("T", [f"t{i}" for i in range(300)])))
    spans = analyze(df, engine=engine).first().spans
    text = "Mr. Kate McDonald-Smith Ann Lee O'Neil went; t299 t3"
    assert [text[s.start : s.end] for s in spans if s.entity_type == "T"] == ["t299", "t3"]
    left = set(range(4, 38)) - {i for s in spans for i in range(s.start, s.end)}
    assert not left


def test_entity_types_fold_case_and_unknown_ones_are_refused(spark):
    df = spark.createDataFrame([(1, "the zip code is 12345")], "id long, text string")
    own = regex_recognizer("Zip", [Pattern("five", "[0-9]{5}", 0.01)], context="zip code")
    engine = EngineOptions(recognizers=(own,))
    spans = analyze(df, analyze_options(entities="zip"), engine).first().spans
    assert [(s.entity_type, s.score) for s in spans] == [("Zip", 0.4)]
    with pytest.raises(ValueError):
        analyze(df, analyze_options(entities="EMAIL"), engine)


@pytest.mark.parametrize(
    "text, entity, values",
    [
        ("see " + "x" * 70 + ".example.com now", "DOMAIN_NAME", ["x" * 70 + ".example.com"]),
        ("at " + "a." * 140 + "org, yes", "DOMAIN_NAME", ["a." * 140 + "org"]),
        ("a." * 20_000 + "com", "DOMAIN_NAME", ["a." * 20_000 + "com"]),
        ("EXAMPLE.COM, Site.Ai and a_b.com. End.No", "DOMAIN_NAME", ["EXAMPLE.COM", "Site.Ai", "a_b.com", "End.No"]),
        ("bücher.de at https://www.a-b.co.uk/x.html?y=z.info", "DOMAIN_NAME", ["bücher.de", "www.a-b.co.uk", "z.info"]),
        ("first.com@b.org, not 1.5 or e.g. this.thing", "DOMAIN_NAME", []),
        ("öl@b.com and o'neil@b.com", "EMAIL_ADDRESS", ["öl@b.com", "o'neil@b.com"]),
        ("a@bü.com a@b.com@c.com x", "EMAIL_ADDRESS", ["a@bü.com", "a@b.com@c.com"]),
        ("'quoted@b.org' {k/v=x!y@b.org} <a+b@c_d.org>", "EMAIL_ADDRESS", ["quoted@b.org", "k/v=x!y@b.org", "a+b@c_d.org"]),
        ("a'" * 50_000 + " " + "b" * 100_000 + "@" + "c." * 50_000 + "d", "EMAIL_ADDRESS", ["b" * 100_000 + "@" + "c." * 50_000 + "d"]),
        ("Emma  Miller, Emma O'Brien-Smith", "PERSON", ["Emma  Miller", "Emma O'Brien-Smith"]),
        ("José da Silva and Juan de la Cruz y Vega here", "PERSON", ["José da Silva", "Juan de la Cruz y Vega"]),
        ("Mr. o'Brien, Dr.  van der Berg, Mrs d’Arcy", "PERSON", ["o'Brien", "van der Berg", "d’Arcy"]),
        ("Emma" + " Abc" * 20_000, "PERSON", ["Emma" + " Abc" * 20_000]),
        ("Mr. nobody and Mr. 5", "PERSON", []),
    ],
)
def test_no_part_of_a_value_is_left(spark, text, entity, values):
    engine = EngineOptions(tuple(recognizers_for(entity)))
    spans = analyze(texts(spark, text), engine=engine, with_text=True).first().spans
    assert [s.text for s in spans] == values
