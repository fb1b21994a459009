"""Phrase tables: punctuation, the way of small and large tables, as recognizers of ``analyze``."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanveil import EngineOptions, PhraseTable, analyze, analyze_and_anonymize, analyze_options, decision_log, gazetteer_spans, recognizers_for, span_rows
from spanveil.operators import phrases
from spanveil.operators.recognizers import alternatives, terms_regex
from spanveil.streaming import streams

WORD = r"[^\W]"
PHRASES = [
    ("St. Paul", "PLACE"), ("Coca-Cola", "BRAND"), ("O'Neil", "PERSON"), ("Yahoo!", "BRAND"), ("(Ltd)", "FORM"), ("a", "A"), ("a a", "AA"),
    ("AC/DC", "BRAND"), ("St.  Paul's\tBay", "PLACE"), ("Zürich", "PLACE"), ("Zürich", "CITY"), ("😀 ok", "X"), ("—", "DASH"), (None, "N"), ("n", None), ("", "E"),
]


def table(spark, rows=None):
    return spark.createDataFrame(PHRASES if rows is None else rows, "phrase string, entity_type string")


def brute(text, rows):
    """Every word-aligned place of every phrase, white space of any length."""
    out = set()
    for phrase, kind in rows:
        if not phrase or kind is None or not re.search(r"\w", phrase):
            continue
        parts = [re.escape(p) for p in re.split(r"\s+", phrase.strip())]
        core_first = re.search(r"\w", phrase.strip()).start() == 0
        core_last = re.search(r"\w$", phrase.strip()) is not None
        regex = (r"(?<!\w)" if core_first else "") + r"\s+".join(parts) + (r"(?!\w)" if core_last else "")
        for at in range(len(text)):
            m = re.compile(regex).match(text, at)
            if m:
                out.add((kind, m.start(), m.end()))
    return out


def texts(seed, n):
    r = random.Random(seed)
    bits = ["St.", "Paul", "Paul's", "Bay", "Coca", "Cola", "Coca-Cola", "O'Neil", "Yahoo!", "(Ltd)", "Ltd", "a", "AC/DC", "Zürich", "😀", "ok", "😀 ok", "—"]
    gaps = [" ", "  ", "\n", "\u00a0", ", ", "-", "", "."]
    return ["".join(r.choice(bits) + r.choice(gaps) for _ in range(r.randrange(50))) for _ in range(n)] + [None, "", "St. Paul", "Yahoo!"]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_equals_brute_force(spark, limit):
    data = texts(3, 80)
    df = spark.createDataFrame(list(enumerate(data)), "id long, text string")
    got = {(r.id, r.entity_type, r.start, r.end) for r in gazetteer_spans(df, table(spark), "id", broadcast_bytes=limit).collect()}
    want = {(i, *x) for i, t in enumerate(data) if t for x in brute(t, PHRASES)}
    assert got == want and len({x[1] for x in got}) == 8


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_values_scores_and_context(spark, limit):
    df = spark.createDataFrame([(1, "Visit lovely St.  Paul or St. Paul; mail a.b@c.org"), (2, "Zürich"), (3, None)], "id long, text string")
    place = PhraseTable(table(spark), score=0.4, context=("lovely",), broadcast_bytes=limit)
    engine = EngineOptions(tuple(recognizers_for("EMAIL_ADDRESS")), phrase_tables=(place,))
    found = analyze(df, None, engine, with_text=True, id_col="id")
    rows = {(r.id, r.entity_type, r.text, round(r.score, 2)) for r in span_rows(found, "id").collect()}
    assert rows == {
        (1, "PLACE", "St.  Paul", 0.75), (1, "PLACE", "St. Paul", 0.75), (1, "EMAIL_ADDRESS", "a.b@c.org", 1.0), (1, "A", "a", 0.4),
        (2, "PLACE", "Zürich", 0.4), (2, "CITY", "Zürich", 0.4),
    }
    options = analyze_options(entities="city,email_address", score_threshold=0.4)
    some = span_rows(analyze(df, options, engine, id_col="id"), "id")
    assert {r.entity_type for r in some.collect()} == {"CITY", "EMAIL_ADDRESS"}
    assert span_rows(analyze(df, analyze_options(score_threshold=0.8, entities="city,place"), engine, id_col="id"), "id").count() == 0
    with pytest.raises(ValueError):
        analyze(df, analyze_options(entities="nothing"), engine, id_col="id")
    log = {(r.entity_type, r.kept, r.reason) for r in decision_log(df, "id", options, engine).collect()}
    assert ("PLACE", False, "entity_type") in log and ("CITY", True, None) in log


def test_languages_and_case(spark):
    df = spark.createDataFrame([(1, "COCA-COLA", "en"), (2, "coca-cola", "de"), (3, "Coca-Cola", None)], "id long, text string, lang string")
    brand = PhraseTable(table(spark), ignore_case=True, languages=("de",))
    got = analyze(df, engine=EngineOptions((), phrase_tables=(brand,)), lang_col="lang", with_text=True)
    assert [(r.id, r.text) for r in span_rows(got, "id").collect()] == [(2, "coca-cola")]


def test_large_table_needs_ids(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    engine = EngineOptions((), phrase_tables=(PhraseTable(table(spark), broadcast_bytes=0),))
    with pytest.raises(ValueError, match="id_col"):
        analyze(df, engine=engine)
    for bad in ({"score": 2}, {"table": spark.range(1)}):
        with pytest.raises(ValueError):
            PhraseTable(**{"table": table(spark), **bad})


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, text string")
    for limit in (1 << 20, -1):
        assert gazetteer_spans(df, table(spark, []), "id", broadcast_bytes=limit).count() == 0


def test_small_table_is_narrow_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(k, f"{k} from St. Paul") for k in range(20)], "doc_id long, text string")
    engine = EngineOptions((), phrase_tables=(PhraseTable(table(spark)),))
    plan = analyze(df, engine=engine)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main
    df.write.parquet(f"{tmp_path}/in")
    arriving = streams.read_stream(spark, f"{tmp_path}/in", "doc_id long, text string")
    streams.anonymize_stream(arriving, f"{tmp_path}/out", f"{tmp_path}/state", "doc_id", engine=engine).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(out) == 20 and all(r.anonymized_text == f"{r.doc_id} from <PLACE>" for r in out)
    assert analyze_and_anonymize(df, "doc_id", engine=engine).count() == 20


def test_hot_runs_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HOT", 50)
    data = ["a " * 200 + "AC/DC", "a"] * 5
    df = spark.createDataFrame(list(enumerate(data)), "id long, text string")
    got = gazetteer_spans(df, table(spark), "id", broadcast_bytes=0).groupBy("entity_type").count()
    assert {r[0]: r[1] for r in got.collect()} == {"A": 1005, "AA": 995, "BRAND": 5}


def test_prefix_trees():
    r = random.Random(4)
    for letters in ("ab", "ab.-é[]^\\ &~|(", "xyzw"):
        for _ in range(60):
            terms = {"".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 40))}
            tree = re.compile(alternatives(terms))
            flat = re.compile("|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))))
            text = "".join(r.choice(letters) for _ in range(300))
            assert [m.span() for m in tree.finditer(text)] == [m.span() for m in flat.finditer(text)]
    with pytest.raises(ValueError):
        alternatives(["a", ""])


def test_long_lists_in_java(spark):
    """The expression of many terms means the same to Spark."""
    r = random.Random(9)
    terms = sorted({"".join(r.choice("abcä.&~- ^[]") for _ in range(r.randint(1, 7))).strip(" .") or "q" for _ in range(3000)})
    text = " ".join(r.choice(terms) + r.choice("x  ") for _ in range(500))
    pattern = terms_regex(terms)
    got = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).first()[0]
    words = r"(?<![^\W])(?:{})(?![^\W])".format("|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))))
    assert got == re.findall(words, text)
