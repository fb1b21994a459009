"""Corpus reports, dictionary matching and spans from outside, against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from spanveil import EngineOptions, Hash, Redact, anonymize, attach_spans, gazetteer_spans
from spanveil.operators import corpus
from spanveil.operators.deanonymize import attach_items

SPAN = "struct<entity_type:string,start:int,end:int,score:double,explanation:string,text:string>"


def sample(spark, n=300):
    """Documents with random values; one value is in a third of them, one fills one document."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        picked = [rng.choice("AB") + str(rng.randrange(40)) for _ in range(rng.randrange(5))]
        if i % 3 == 0:
            picked.append("A_hot")
        if i == 7:
            picked += ["B_own"] * 500
        text, spans = "", []
        for p in picked:
            text += " "
            spans.append((p[0], len(text), len(text) + len(p), round(rng.random(), 1), None, p))
            text += p
        rows.append((i, rng.choice(["en", "de"]), text, spans))
    return rows, spark.createDataFrame(rows, f"id long, lang string, text string, spans array<{SPAN}>")


def test_summary(spark):
    rows, df = sample(spark)
    spans, docs, score = Counter(), defaultdict(set), Counter()
    for i, lang, _, ss in rows:
        for s in ss:
            for key in itertools.product((s[0], "ALL"), (lang, None)):
                spans[key] += 1
                docs[key].add(i)
                score[key] += s[3]
    got = {(r.entity_type, r.lang): (r.spans, r.documents, r.mean_score) for r in corpus.entity_summary(df, "lang").collect()}
    assert got.keys() == spans.keys()
    for k, (n, d, m) in got.items():
        assert (n, d) == (spans[k], len(docs[k])) and abs(m - score[k] / n) < 1e-5


def test_links(spark):
    rows, df = sample(spark)
    values = corpus.doc_values(df, "id")
    places = defaultdict(Counter)
    for i, _, _, ss in rows:
        for s in ss:
            places[(s[0], hashlib.sha256(s[5].lower().encode()).hexdigest())][i] += 1
    got = {(r.entity_type, r.value_hash): (r.documents, r.occurrences, r.first_document)
           for r in corpus.link_values(values, "id").collect()}
    assert got == {k: (len(c), sum(c.values()), min(c)) for k, c in places.items()}
    top = corpus.top_values(values, "id", 1).first()
    assert top.documents == max(len(c) for c in places.values())
    edges = Counter()
    for c in places.values():
        for d in c:
            if d != min(c):
                edges[(min(c), d)] += 1
    for salts in (1, 3, 128):
        linked = corpus.link_documents(values, "id", salts=salts).collect()
        assert {(r.hub, r.id): r.shared_values for r in linked} == edges


def test_links_spread_a_hot_value(spark):
    """No join partition sees all documents of one value."""
    df = spark.range(2000).select("id", F.lit("A").alias("entity_type"), F.unhex(F.lit("00")).alias("value"), F.lit(1).cast("long").alias("n"))
    linked = corpus.link_documents(df, "id", salts=64)
    assert linked.count() == 1999
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_types_together(spark):
    rows, df = sample(spark)
    sets = [frozenset(s[0] for s in ss) for _, _, _, ss in rows if ss]
    got = {frozenset(r.types): r.documents for r in corpus.type_sets(df).collect()}
    assert got == Counter(sets)
    matrix = {r.entity_type: r for r in corpus.type_cooccurrence(df, ["A", "B"]).collect()}
    for a in "AB":
        for b in "AB":
            assert matrix[a][b] == sum(a in s and b in s for s in sets)


def test_frequencies_and_leaks(spark):
    rows, df = sample(spark)
    done = anonymize(df, {"A": Hash("md5"), "B": Redact()}, id_col="id")
    got = {r.entity_type: r for r in corpus.frequency_change(done, "text").collect()}
    distinct = {e: len({s[5] for *_, ss in rows for s in ss if s[0] == e}) for e in "AB"}
    assert (got["A"].distinct_before, got["A"].distinct_after, got["A"].max_abs_diff) == (distinct["A"], distinct["A"], 0)
    assert (got["B"].distinct_before, got["B"].distinct_after) == (distinct["B"], 1) and got["B"].max_abs_diff > 0
    assert corpus.leaks(done, "id").count() == 0
    half = df.withColumn("part", F.filter("spans", lambda s: s["entity_type"] == "A"))
    open_ = anonymize(half, spans_col="part", id_col="id")
    want = {(i, s[5]) for i, _, _, ss in rows for s in ss if s[0] == "B"}
    assert {(r.id, r.text) for r in corpus.leaks(open_, "id").collect()} == want


def test_histogram(spark):
    rows, df = sample(spark)
    want = Counter((s[0], s[3]) for *_, ss in rows for s in ss)
    assert {(r.entity_type, r.bucket): r.spans for r in corpus.score_histogram(df).collect()} == want


def brute_phrases(text, phrases):
    tokens = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\w+", text)]
    out = []
    for a in range(len(tokens)):
        for z in range(a, min(a + 3, len(tokens))):
            run = tokens[a:z + 1]
            if all(text[x[1]:y[0]].isspace() for x, y in itertools.pairwise(run)):
                phrase = " ".join(t[2] for t in run)
                out += [(e, run[0][0], run[-1][1]) for e in phrases.get(phrase, ())]
    return sorted(out)


def test_gazetteer(spark):
    rng = random.Random(11)
    words = ["New", "York", "City", "é", "Über", "of", "a"]
    gaps = [" ", "  ", "\n", ", ", "-"]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60))) for _ in range(60)]
    phrases = {"New York": ["PLACE"], "New York City": ["PLACE", "TOWN"], "York": ["NAME"], "é": ["X"], "City of a": ["Y"]}
    table = spark.createDataFrame([(p, e) for p, es in phrases.items() for e in es], "phrase string, entity_type string")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {(i, *s) for i, t in enumerate(texts) for s in brute_phrases(t, phrases)}
    for limit in (1 << 20, 0):
        got = gazetteer_spans(df, table, "id", broadcast_bytes=limit)
        rows = [(r.id, r.entity_type, r.start, r.end) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    shouted = df.select("id", F.upper("text").alias("text"))
    folded = gazetteer_spans(shouted, table.where("phrase = 'York'"), "id", ignore_case=True)
    assert folded.count() == sum(s[1] == "NAME" for s in want)


def test_external_spans(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, "xyz")], "id long, text string")
    rows = spark.createDataFrame([(1, "A", 0, 2, 0.4), (1, "A", 0, 2, 0.8), (1, "B", 1, 3, 0.5), (9, "C", 0, 1, 1.0)],
                                 "id long, entity_type string, start int, end int, score double")
    got = {r.id: [tuple(s)[:4] for s in r.spans] for r in attach_spans(df, rows, "id").collect()}
    assert got == {1: [("A", 0, 2, 0.8), ("B", 1, 3, 0.5)], 2: []}
    again = attach_spans(attach_spans(df, rows, "id"), rows.where("entity_type = 'B'").withColumn("score", F.lit(0.9)), "id")
    assert [tuple(s)[:4] for s in again.where("id = 1").first().spans] == [("A", 0, 2, 0.8), ("B", 1, 3, 0.9)]
    items = spark.createDataFrame([(1, "x")], "id long, items string")
    assert attach_items(df, items, "id").count() == 2


def test_engine_registry_adds():
    from spanveil import PREDEFINED, deny_list_recognizer

    extra = deny_list_recognizer("T", "a,b")
    assert len(EngineOptions(deny_list=(extra,)).registry()) == len(PREDEFINED) + 1


def test_reports_detect_once(spark, sf):
    """Each report goes over the texts once and shuffles small rows only."""
    from spanveil import analyze, recognizers_for

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    found = analyze(docs, engine=EngineOptions(tuple(recognizers_for("EMAIL_ADDRESS"))), with_text=True)
    values = corpus.doc_values(found, "doc_id")
    reports = {
        "summary": corpus.entity_summary(found, "lang"), "values": corpus.link_values(values, "doc_id"),
        "sets": corpus.type_sets(found), "matrix": corpus.type_cooccurrence(found, ["EMAIL_ADDRESS"]),
        "histogram": corpus.score_histogram(found), "leaks": corpus.leaks(anonymize(found), "doc_id"),
        "frequencies": corpus.frequency_change(anonymize(found), "text"),
    }
    for name, df in reports.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("RLIKE") == 1, name
        for line in plan.splitlines():
            if "Exchange" in line:
                assert "text#" not in line, name
