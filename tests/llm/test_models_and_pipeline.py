import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanveil.llm.decontamination import Matcher, contaminated, decontaminate, distance_within, normal, passages, verdicts
from spanveil.llm.hmm_lm import Counts, Model, Settings, likelihoods, runs, score_texts
from spanveil.llm.line_dedup import line_dedup
from spanveil.llm.near_copies import without_near_copies
from spanveil.llm.packing import pack
from spanveil.llm.quality_rules import keep_good
from tests.llm.helpers import bare, corpus, frame, prose

# ---------------------------------------------------------------- decontamination


def edits(pattern, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != d), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)


def test_bit_parallel_distance():
    r = random.Random(3)
    for _ in range(1500):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 90 if _ % 50 == 0 else 12)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 100 if _ % 50 == 0 else 20)))
        k = r.randint(0, 12)
        d = edits(p, t)
        assert distance_within(p, t, k) == (d if d <= k else None)


def items_and_rows():
    r = random.Random(8)
    items = [(k, prose(900 + k, 60)[: r.choice([30, 90, 130, 300])]) for k in range(12)] + [(50, None), (51, ""), (52, "tiny"), (0, prose(900, 60)[:90]), (None, prose(999, 60))]
    rows, extra = corpus(), corpus()[0][5:]
    for k, (_, text) in enumerate(items[:12]):
        changed = list(text)
        for _ in range(k % 4):
            changed[r.randrange(len(changed))] = r.choice(["", "x", "yz"])
        rows.append((600 + k, prose(30 + k, 40) + "".join(changed).upper() + prose(60 + k, 30), "en", "host1", None, *extra))
    return items, rows


def test_contamination_against_brute_force(spark):
    items, rows = items_and_rows()
    want = []
    for x in rows:
        body, found = normal(x[1]), {}
        for item, text in items:
            for _, passage, budget in passages(0, text, size=120, errors=0.05, least=20):
                d = edits(passage, body)
                if d <= budget:
                    found[item] = min(d, found.get(item, d))
        want.append((x[0], bool(found), sorted((i for i in found), key=lambda i: (i is not None, i)), min(found.values(), default=None)))
    df = spark.createDataFrame(items, "item_id long, text string")
    got = verdicts(frame(spark, rows), df).collect()
    real = [(a, b, [i for i in c if i is not None], d) for a, b, c, d in want]
    assert sum(x[1] for x in want) >= 5
    assert bare((r["doc_id"], r["contaminated"], r["item_ids"], r["distance"]) for r in got) == bare(real)
    kept = decontaminate(frame(spark, rows), df)
    assert bare(kept.collect()) == bare(x for x, w in zip(rows, want) if not w[1])
    blocks = contaminated(frame(spark, rows), df, block_chars=200)
    assert set(map(tuple, blocks.collect())) == set(map(tuple, contaminated(frame(spark, rows), df).collect()))


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert verdicts(frame(spark), none).where("contaminated").count() == 0
    assert decontaminate(frame(spark, []), none).count() == 0
    assert Matcher([]).find("text") == {}


# ---------------------------------------------------------------- language model


def test_expected_counts_and_likelihood_against_all_paths():
    rng = np.random.default_rng(0)
    k, c = 3, 5
    m = Model(rng.dirichlet(np.ones(c), k).T, rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k)))
    for n in (1, 2, 5):
        seen = rng.integers(0, c, n).astype(np.int32)
        total, emit, move, begin = 0.0, np.zeros((k, c)), np.zeros((k, k)), np.zeros(k)
        for path in itertools.product(range(k), repeat=n):
            p = m.begin[path[0]] * np.prod([m.emit[seen[i], path[i]] for i in range(n)]) * np.prod([m.move[path[i], path[i + 1]] for i in range(n - 1)])
            total += p
            begin[path[0]] += p
            for i in range(n):
                emit[path[i], seen[i]] += p
            for i in range(n - 1):
                move[path[i], path[i + 1]] += p
        assert likelihoods(m, [seen, seen[:0], seen])[[0, 2]] == pytest.approx([math.log10(total)] * 2)
        counts = Counts(c, k)
        counts.add(m, *runs([seen], 7))
        assert np.allclose(counts.emit, emit / total, atol=1e-5) and np.allclose(counts.move, move / total, atol=1e-5)
        assert np.allclose(counts.begin, begin / total, atol=1e-5)
    texts = [np.arange(n, dtype=np.int32) for n in (1, 4, 5, 9)]
    seen, filled, first = runs(texts, 4)
    assert filled.sum() == 19 and first.sum() == 4 and sorted(seen[filled].tolist()) == sorted(np.concatenate(texts).tolist())


def test_scores(spark):
    rows, extra = corpus(), corpus()[0][5:]
    left, right = "uno dos tres cuatro cinco seis".split(), "ett tva tre fyra fem sex".split()
    r = random.Random(6)
    rows += [(1000 + k, " ".join(r.choice(left if k % 2 else right) for _ in range(60)), "en", "h", None, *extra) for k in range(200)]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    tokens = [(x[1] or "").encode().lower().split() + [None] for x in rows]
    n = Counter(t for x, w in zip(rows, tokens) if not held(x[0]) for t in w)
    total = sum(n.values())
    for settings in (Settings(states=4, frequent=8, shared=16, sample=50), Settings(states=4, frequent=500)):
        got = score_texts(frame(spark, rows), settings=settings).collect()
        base = [sum(math.log10((n[t] + 0.5) / (total + 0.5 * (len(n) + 1))) for t in w) for w in tokens]
        want = [(x[0], held(x[0]), len(w), sum(n[t] > 0 for t in w), total, round(b, 6)) for x, w, b in zip(rows, tokens, base)]
        mine = [(g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 6)) for g in got]
        assert bare(mine) == bare(want)
    out = [g for g in got if g["held_out"] and (g["doc_id"] or 0) >= 1000]
    assert sum(g["score"] for g in out) > sum(g["base_score"] for g in out)


def test_probabilities_of_all_short_texts_sum_to_one_at_most(spark):
    """Every text over the known words and one unknown word, of one word."""
    extra = corpus()[0][5:]
    train = [(k, t, "en", "h", None, *extra) for k, t in enumerate(["a a b", "b c", "a c c", "d"] * 4)]
    probe = [(10_000 + 5 * k, t, "en", "h", None, *extra) for k, t in enumerate(["", "a", "b", "c", "d", "zzz"])]
    ids = [i for i in range(20_000, 30_000) if zlib.crc32(str(i).encode()) % 5 == 1]
    probe = [(ids[k], *x[1:]) for k, x in enumerate(probe)]
    got = score_texts(frame(spark, train + probe), settings=Settings(states=2, frequent=2, shared=8)).collect()
    assert 0 < sum(10 ** g["score"] for g in got if g["doc_id"] >= 20_000) <= 1


def test_scores_of_an_empty_table(spark):
    assert score_texts(frame(spark, [])).count() == 0


def test_all_rounds_read_all_training_texts(spark, monkeypatch):
    """Expected counts of every round add up to the tokens of all training texts, also of many."""
    seen, real = [], Model.from_counts
    monkeypatch.setattr(Model, "from_counts", staticmethod(lambda emit, *rest: (seen.append(emit.sum()), real(emit, *rest))[1]))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id") % 7, F.col("id") % 11).alias("text"))
    train = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1).count()
    score_texts(docs, settings=Settings(states=2, frequent=8, shared=4))
    assert seen == [pytest.approx(3 * train, rel=1e-4)] * 10


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    items, rows = items_and_rows()
    rows = [x for x in rows if x[0] is not None]
    extra = corpus()[0][5:]
    # near copies on one small host would make boilerplate of each other's lines
    near = [(800 + k, prose(70, 150) + f" tail{k}", "en", f"near{k}", None, *extra) for k in range(6)]
    lines = [(820 + k, prose(820 + k, 60) + "\nfooter of the place", "de", "host3", None, *extra) for k in range(30)]
    documents = frame(spark, rows + near + lines).select("doc_id", "text", "lang", "source", "n_chars")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {x["doc_id"] for x in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).collect(), documents.schema)
        assert {x["doc_id"] for x in kept.collect()} <= before
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = decontaminate(without_near_copies(line_dedup(keep_good(docs, clean=True)).select(*docs.columns)), spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    want = {x["doc_id"]: x["text"] for x in want.collect()}
    assert {x["doc_id"]: x["text"] for x in kept.collect()} == want
    assert 800 in want and not any(801 <= k < 806 for k in want) and all(820 + k in want for k in range(30))
    assert not any("footer" in t for t in want.values()) and 600 not in want
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in got} == set(want)
    packed = pack(kept, public_tokenizers.path(corpus_pipeline.TOKENIZER))
    tokens = {x["doc_id"]: x["n"] for x in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    mine = Counter()
    for x in got:
        mine[x["doc_id"]] += x["length"]
    assert dict(mine) == tokens
