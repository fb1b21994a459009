"""Anonymizing and restoring."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spanveil import (
    Custom,
    Encrypt,
    EngineOptions,
    Hash,
    Mask,
    Pseudonym,
    Redact,
    Replace,
    analyze,
    analyze_and_anonymize,
    anonymize,
    deanonymize,
    recognizers_for,
)
from spanveil.functions.spans import merge_overlaps, surfaces

TEXT = "Emma's new social security card: 123-45-6789.  A driver license today is 7654321B."
KEY = "MDEyMzQ1Njc4OWFiY2RlZg=="
SPAN = "struct<entity_type:string,start:int,end:int,score:double>"


def one(spark, text=TEXT):
    return analyze(spark.createDataFrame([(1, text)], "id long, text string"))


def given(spark, text, spans):
    return spark.createDataFrame([(1, text, spans)], f"id long, text string, spans array<{SPAN}>")


def items(row):
    return [(i.operator, i.entity_type, i.start, i.end) for i in row["items"]]


def test_encrypt_and_defaults(spark):
    row = anonymize(one(spark), {"PERSON": Encrypt(KEY)}, id_col="id").first()
    sealed = row.anonymized_text[:44]
    assert row.anonymized_text == (
        f"{sealed}'s new social security card: <US_SSN>.  A driver license today is <US_DRIVER_LICENSE>.")
    assert items(row) == [
        ("replace", "US_DRIVER_LICENSE", 110, 129), ("replace", "US_SSN", 73, 81), ("encrypt", "PERSON", 0, 44)]


def test_restore(spark):
    done = anonymize(one(spark), {"PERSON": Encrypt(KEY)}, id_col="id")
    row = deanonymize(done, {"PERSON": KEY}).first()
    assert row.restored_text == "Emma's new social security card: <US_SSN>.  A driver license today is <US_DRIVER_LICENSE>."
    assert [tuple(i) for i in row.restored_items] == [("decrypt", "PERSON", 0, 4, "Emma")]
    assert row.status == "ok"


@pytest.mark.parametrize("mode", ["CBC", "GCM"])
def test_long_values_stay_on_one_line(spark, mode):
    text = "é😀" * 300
    done = anonymize(given(spark, text, [("X", 0, 600, 1.0)]), {"X": Encrypt(KEY, mode)}, id_col="id")
    assert "\n" not in done.first().anonymized_text
    assert deanonymize(done, {"X": KEY}, mode=mode).first().restored_text == text


def test_base64_keys(spark):
    done = anonymize(one(spark), {"PERSON": Encrypt(KEY, base64_key=True)}, id_col="id")
    assert deanonymize(done, {"PERSON": KEY}, base64_key=True).first().restored_text.startswith("Emma")


def test_statuses(spark):
    done = anonymize(one(spark), {"PERSON": Encrypt(KEY, "GCM")}, id_col="id")
    wrong = deanonymize(done, {"PERSON": KEY[::-1]}, mode="GCM").first()
    assert (wrong.status, wrong.restored_items, wrong.restored_text == wrong.anonymized_text) == ("bad_key", [], True)
    assert deanonymize(done, {"OTHER": KEY}, mode="GCM").first().status == "missing_key"
    df = spark.createDataFrame([(1, None, []), (2, "a", None), (3, "ab", [("X", 1, 9, 1.0)])],
                               f"id long, text string, spans array<{SPAN}>")
    got = anonymize(df).orderBy("id").collect()
    assert [(r.status, r.anonymized_text) for r in got] == [
        ("missing_text", None), ("missing_spans", None), ("clipped_spans", "a<X>")]


def test_every_operator(spark):
    spans = [(e, i * 5, i * 5 + 4, 1.0) for i, e in enumerate("ABCDEFGHIJ")]
    text = " ".join(f"val{i}" for i in range(10))
    operators = {
        "A": Replace(), "B": Replace("new"), "C": Redact(), "D": Mask("*", 2), "E": Mask("#", 3, True),
        "F": Mask("x", 99), "G": Hash("md5"), "H": Hash("sha512"), "I": Custom(F.upper), "J": Pseudonym("s"),
    }
    out = anonymize(given(spark, text, spans), operators, id_col="id").first().anonymized_text.split(" ")
    assert out[:6] == ["<A>", "new", "", "**l3", "v###", "xxxx"]
    assert out[6] == hashlib.md5(b"val6").hexdigest() and out[7] == hashlib.sha512(b"val7").hexdigest()
    assert out[8] == "VAL8" and out[9] == f"<J_{hashlib.sha256(b'sval9').hexdigest()[:32]}>"


def test_default_operator(spark):
    assert anonymize(one(spark), {"DEFAULT": Redact(), "US_SSN": Replace("N")}).first().anonymized_text == (
        "'s new social security card: N.  A driver license today is .")


def test_config_table(spark):
    rows = [("A", "mask", None, None, None, "*", 2, True), ("B", "hash", None, "md5", None, None, None, None),
            ("C", "encrypt", None, None, KEY, None, None, None), ("D", "nonsense", None, None, None, None, None, None),
            ("E", "replace", "n", None, None, None, None, None), ("F", "redact", None, None, None, None, None, None),
            ("H", "encrypt", None, None, "too short", None, None, None)]
    config = spark.createDataFrame(rows, "entity_type string, type string, new_value string, hash_type string, key string, "
                                         "masking_char string, chars_to_mask int, from_end boolean")
    spans = [(e, i * 5, i * 5 + 4, 1.0) for i, e in enumerate("ABCDEFGH")]
    df = given(spark, " ".join(f"val{i}" for i in range(8)), spans)
    done = anonymize(df, config, id_col="id")
    out = done.first().anonymized_text.split(" ")
    assert out[:2] == ["va**", hashlib.md5(b"val1").hexdigest()] and out[3:] == ["<D>", "n", "", "<G>", "<H>"]
    assert deanonymize(done, config.where("type = 'encrypt'")).first().restored_text.split(" ")[2] == "val2"


def test_config_tables_of_any_size(spark):
    rows = spark.range(10_001).select(F.col("id").cast("string").alias("entity_type"), F.lit("redact").alias("type"))
    more = spark.createDataFrame([(None, "redact"), ("X", "redact")], "entity_type string, type string")
    assert "Emma" not in anonymize(one(spark), rows.union(more)).first().anonymized_text


def test_a_null_replacement_deletes_nothing_around(spark):
    df = given(spark, "keep this a@b.com and that", [("EMAIL_ADDRESS", 10, 17, 1.0)])
    done = anonymize(df, {"EMAIL_ADDRESS": Custom(lambda v: F.when(F.length(v) > 100, "x"))}, id_col="id").first()
    assert done.anonymized_text == "keep this <EMAIL_ADDRESS> and that"
    assert [(i.start, i.end) for i in done["items"]] == [(10, 25)]


def test_text_outside_the_islands_stays_whatever_is_null(spark):
    rng, rows = random.Random(9), []
    for k in range(60):
        text = "".join(rng.choice("abcdé😀 ") for _ in range(rng.randint(0, 30)))
        pick = lambda x: None if rng.random() < 0.2 else x
        spans = [(pick(rng.choice("AB")), pick(rng.randint(-3, 32)), pick(rng.randint(-3, 32)), pick(rng.random())) for _ in range(rng.randint(0, 4))]
        rows.append((k, text, spans))
    df = spark.createDataFrame(rows, f"id long, text string, spans array<{SPAN}>")
    got = {r.id: r for r in anonymize(df, {"A": Redact(), "DEFAULT": Replace("")}, id_col="id").collect()}
    for k, text, spans in rows:
        covered = {i for _, a, b, _ in spans if a is not None and b is not None for i in range(max(a, 0), min(b, len(text)))}
        assert got[k].anonymized_text == "".join(c for i, c in enumerate(text) if i not in covered)
        wrong = any(a is None or b is None or a < 0 or b > len(text) or a >= b for _, a, b, _ in spans)
        assert got[k].status == ("clipped_spans" if wrong else "ok")


def test_overlaps_become_islands(spark):
    spans = [("A", 0, 5, 0.5), ("B", 3, 8, 0.9), ("C", 8, 10, 0.1), ("D", 12, 20, 0.5), ("E", 13, 15, 0.5), ("F", 12, 20, 0.5)]
    row = anonymize(given(spark, "abcdefghijklmnopqrstuvw", spans)).first()
    assert row.anonymized_text == "<B><C>kl<F>uvw"


def brute(spans):
    out = []
    for e, s, t, sc in sorted(spans, key=lambda x: (x[1], x[2], x[3], x[2] - x[1], x[0])):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], t)
            out[-1][2] = max(out[-1][2], (sc, t - s, e))
        else:
            out.append([s, t, (sc, t - s, e)])
    return [(o[0], o[1], o[2][2]) for o in out]


def test_islands_and_rewriting_against_python(spark):
    """Random spans, few and very many, on texts with wide characters."""
    rng = random.Random(3)
    rows = []
    for i, n in enumerate([0, 1, 2, 5, 31, 32, 33, 70, 700, 3000]):
        text = "".join(rng.choice("ab é😀\n") for _ in range(n * 4 + 10))
        spans = []
        for _ in range(n):
            a = rng.randrange(len(text))
            spans.append((rng.choice("ABC"), a, min(len(text), a + rng.randint(1, 5)), rng.choice([0.3, 0.6, 1.0])))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, f"id long, text string, spans array<{SPAN}>")
    done = anonymize(df, {"A": Redact(), "B": Mask("*", 1)}).withColumn("islands", merge_overlaps(F.col("spans")))
    done = done.withColumn("cut", surfaces(F.col("text"), F.col("islands"), ["start", "end"]))
    for r in done.collect():
        text, want = r.text, brute([tuple(s) for s in r.spans])
        assert [(x.start, x.end, x.entity_type) for x in r.islands] == want
        assert [c.text for c in r.cut] == [text[s:t] for s, t, _ in want]
        out, at, places = "", 0, []
        for s, t, e in want:
            new = {"A": "", "B": "*" + text[s + 1:t], "C": "<C>"}[e]
            out += text[at:s]
            places.append((len(out), len(out) + len(new), new))
            out, at = out + new, t
        assert r.anonymized_text == out + text[at:]
        assert [(i.start, i.end, i.text) for i in reversed(r["items"])] == places


def test_pieces_across_blocks(spark):
    text = "".join(chr(97 + i % 26) if i % 5 else "😀" for i in range(10000))
    spans = [("A", 0, 1, 1.0), ("A", 4090, 4100, 1.0), ("A", 5000, 9500, 1.0), ("A", 9999, 10000, 1.0)]
    row = anonymize(given(spark, text, spans), {"A": Replace("#")}).first()
    assert row.anonymized_text == "#" + text[1:4090] + "#" + text[4100:5000] + "#" + text[9500:9999] + "#"


def test_keys_stay_out_of_plans(spark):
    done = deanonymize(anonymize(one(spark), {"PERSON": Encrypt(KEY), "US_SSN": Pseudonym("pepper")}, id_col="id"), {"PERSON": KEY})
    plan = done._jdf.queryExecution().toString()
    assert KEY not in plan and "pepper" not in plan
    assert KEY not in repr(Encrypt(KEY))


def test_same_value_same_cipher_only_at_the_same_place(spark):
    spans = [("A", 0, 3, 1.0), ("A", 4, 7, 1.0)]
    df = spark.createDataFrame([(1, "abc abc", spans), (2, "abc abc", spans)], f"id long, text string, spans array<{SPAN}>")
    done = anonymize(df, {"A": Encrypt(KEY)}, id_col="id").select(F.explode(F.split("anonymized_text", " ")).alias("c"))
    assert done.distinct().count() == 4


def test_corpus_round_trip(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    engine = EngineOptions(tuple(recognizers_for("EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS", "CREDIT_CARD")))
    done = analyze_and_anonymize(df, "doc_id", {"DEFAULT": Encrypt(KEY)}, engine=engine)
    back = deanonymize(done, {"DEFAULT": KEY})
    assert back.where((F.col("restored_text") != F.col("text")) | (F.col("status") != "ok")).count() == 0
    assert done.where(F.size("items") > 0).count() > 0


def test_anonymizing_is_narrow(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    engine = EngineOptions(tuple(recognizers_for("EMAIL_ADDRESS")))
    done = analyze_and_anonymize(df, "doc_id", engine=engine).select("doc_id", "anonymized_text", "items")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("RLIKE") == 1


@pytest.mark.parametrize("make", [
    lambda: Mask("**", 1), lambda: Mask("*", -1), lambda: Hash("sha1"), lambda: Encrypt("short"),
    lambda: Encrypt(KEY, "ECB"), lambda: deanonymize(None, {}),
])
def test_bad_operators_fail_early(make):
    with pytest.raises(ValueError):
        make()


def test_unknown_operator(spark):
    with pytest.raises(ValueError):
        anonymize(one(spark), {"PERSON": "mask"})
