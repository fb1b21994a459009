"""Groups of documents, islands of long span tables, cubes and sketches, leaks across documents."""

import random

import pytest
from pyspark.sql import functions as F

from spanveil import EngineOptions, analyze, anonymize, recognizers_for
from spanveil.functions.spans import merge_overlaps
from spanveil.operators import corpus, identity


def closure(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(root)}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    r = random.Random(7)
    edges = {
        "random": [(r.randrange(120), r.randrange(120)) for _ in range(90)], "path": [(k, k + 1) for k in range(60)],
        "star": [(50, k) for k in range(200)], "none": [],
    }[kind]
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "a long, b long")
    got = {tuple(x) for x in identity.components(df, "a", "b").collect()}
    assert got == closure([e for e in edges if e[0] != e[1]])


def test_groups_of_documents(spark):
    rows = [(1, "A", b"x"), (2, "A", b"x"), (2, "B", b"y"), (5, "B", b"y"), (7, "A", b"y"), (8, "C", b"z"), (8, "A", b"q"), (None, "A", b"q")]
    values = spark.createDataFrame([(i, e, v, 2) for i, e, v in rows], "id long, entity_type string, value binary, n long")
    groups = identity.identity_groups(values, "id")
    assert {tuple(x) for x in groups.collect()} == {(1, 1, 3), (2, 1, 3), (5, 1, 3), (7, 7, 1), (8, 8, 1)}
    held = {tuple(x) for x in identity.value_groups(values.where("id IS NOT NULL"), groups, "id").collect()}
    assert held == {(1, "A", 1, 4), (1, "B", 1, 4), (7, "A", 1, 2), (8, "A", 1, 2), (8, "C", 1, 2)}
    assert identity.identity_groups(values.limit(0), "id").count() == 0


@pytest.mark.parametrize("reach", [3, 17, 1 << 16])
def test_islands_equal_those_of_arrays(spark, reach):
    r = random.Random(reach)
    rows = []
    for k in range(400):
        at = r.randrange(300)
        rows.append((k % 7, at, at + r.choice([0, 1, 2, 5, 40]), r.choice("ABC"), r.choice([0.1, 0.5, 0.5, 1.0])))
    rows += [(1, None, 4, "A", 1.0), (2, 4, None, "A", 1.0), (3, 9, 3, "A", 1.0), *rows[:20]]
    df = spark.createDataFrame(rows, "id long, start int, `end` int, entity_type string, score double")
    good = df.where("start < `end`").groupBy("id").agg(F.collect_list(F.struct("start", "end", "entity_type", "score")).alias("s"))
    islands = good.select("id", F.explode(merge_overlaps(F.col("s"))).alias("i")).select("id", "i.*")
    columns = ["id", "start", "end", "entity_type", "score"]
    want = sorted(tuple(x[c] for c in columns) for x in islands.collect())
    got = sorted(tuple(x[c] for c in columns) for x in identity.span_islands(df, "id", reach=reach).collect())
    assert got == want and len(got) > 20


def spanned(spark):
    rows = [(1, "en", "a"), (2, "en", "b"), (3, None, "a"), (4, None, None), (5, "de", "b")]
    text = {1: "a@b.org, c@d.org", 2: "a@b.org", 3: "a@b.org a@b.org", 4: "10.0.0.1", 5: "none"}
    df = spark.createDataFrame([(i, lang, src, text[i]) for i, lang, src in rows], "id long, lang string, src string, text string")
    return analyze(df, engine=EngineOptions(tuple(recognizers_for("EMAIL_ADDRESS", "IP_ADDRESS"))), with_text=True)


def test_levels_tell_totals_from_nulls(spark):
    got = {tuple(r)[:6] for r in corpus.entity_summary(spanned(spark), ["lang", "src"]).where("entity_type = 'EMAIL_ADDRESS'").collect()}
    assert got == {
        ("EMAIL_ADDRESS", "en", "a", 0, 2, 1), ("EMAIL_ADDRESS", "en", "b", 0, 1, 1), ("EMAIL_ADDRESS", None, "a", 0, 2, 1),
        ("EMAIL_ADDRESS", "en", None, 1, 3, 2), ("EMAIL_ADDRESS", None, None, 1, 2, 1), ("EMAIL_ADDRESS", None, "a", 2, 4, 2),
        ("EMAIL_ADDRESS", None, "b", 2, 1, 1), ("EMAIL_ADDRESS", None, None, 3, 5, 3),
    }
    one = corpus.entity_summary(spanned(spark), "lang").where("entity_type = 'EMAIL_ADDRESS' AND lang IS NULL").collect()
    assert {(r.level, r.spans) for r in one} == {(0, 2), (1, 5)}
    with pytest.raises(ValueError):
        corpus.entity_summary(spanned(spark), [])


def test_sketches_merge(spark):
    days = [spanned(spark).withColumn("day", F.lit(d)) for d in (1, 2)]
    fine = corpus.entity_sketches(days[0], "id", ["day", "lang"]).union(corpus.entity_sketches(days[1], "id", ["day", "lang"]))
    got = {tuple(r) for r in corpus.read_sketches(corpus.merge_sketches(fine)).collect()}
    assert got == {("EMAIL_ADDRESS", 10, 3, 2), ("IP_ADDRESS", 2, 1, 1)}
    many = spark.range(40_000).select(
        "id", F.array(F.struct(F.lit("N").alias("entity_type"), F.concat(F.lit("v"), F.col("id") % 9000).alias("text"))).alias("spans"), F.lit(1).alias("day")
    )
    row = corpus.read_sketches(corpus.entity_sketches(many, "id", "day")).first()
    assert abs(row.documents / 40_000 - 1) < 0.05 and abs(row["values"] / 9000 - 1) < 0.05


def test_values_of_other_documents(spark):
    df = spark.createDataFrame([(1, "mail a@b.org now"), (2, "A@b.org or xa@b.orgy"), (3, "call 10.0.0.1"), (4, None)], "id long, text string")
    found = analyze(df, engine=EngineOptions(tuple(recognizers_for("EMAIL_ADDRESS", "IP_ADDRESS"))), with_text=True)
    # what was found in the first document stays in the second's text, and the third was not rewritten
    some = found.withColumn("kept", F.col("spans")).withColumn("spans", F.expr("if(id = 1, spans, slice(spans, 1, 0))"))
    done = anonymize(some, id_col="id").withColumn("anonymized_text", F.expr("if(id = 2, 'see a@b.org!', anonymized_text)"))
    got = {tuple(r) for r in corpus.leaks_across(done, "id", spans_col="kept").collect()}
    assert got == {(2, "EMAIL_ADDRESS", 4, 11, "a@b.org"), (3, "IP_ADDRESS", 5, 13, "10.0.0.1")}
