import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanveil.llm import hard_negatives as hn
from spanveil.llm.hard_negatives import combine, hard_negatives, prepared, primes_for, products, residues
from tests.llm.helpers import bare

SCHEMA = "vec_id long, embedding array<float>, label int, row long, anchor long, vector string, score double, place int"


def brute(rows, every=100, scale=256):
    kept = []
    for r in rows:
        i, v, label = r[:3]
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for at, (i, v, label) in enumerate(kept):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, lab == label) for k, (j, w, lab) in enumerate(kept) if k != at]
        for ps, pid, _ in sorted(s for s in scored if s[2])[:5]:
            fits = sorted(s for s in scored if not s[2] and 80 * -ps <= 100 * -s[0] <= 100 * -ps)[:5]
            out += [(i, pid, n, j, -ps, -s) for n, (s, j, _) in enumerate(fits, 1)]
    return bare(out)


def run(spark, rows, every=100, **more):
    df = spark.createDataFrame([tuple(r) + (1, 2, "clash", 0.5, 3) for r in rows], SCHEMA).repartition(4)
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return bare(tuple(r) for r in hard_negatives(prepared(df, label=label), F.col("vec_id") % every == 0, **more).collect())


def vectors(seed, n, width=16, kinds=4):
    r = random.Random(seed)
    centre = [[r.gauss(0, 0.3) for _ in range(width)] for _ in range(kinds)]
    return [(i, [c + r.gauss(0, 0.2) for c in centre[i % kinds]], r.randrange(kinds)) for i in range(n)]


def awkward():
    rows = vectors(1, 320)
    same = rows[100][1]
    rows += [(1000 + k, same, k % 3) for k in range(60)]  # many ties
    rows += [rows[100], rows[100], rows[7], (200, same, 1)]  # repeated rows and ids
    rows += [
        (None, same, 1), (2000, None, 1), (2001, same, None), (2002, [], 1), (2100, [], 2), (2003, [1.0, None], 1), (2004, [float("nan")] * 16, 1),
        (2005, [float("inf")] * 16, 1), (2006, same[:5], 0), (2200, same + [3.0], 0), (-100, same, 2), (2300, [0.0] * 16, 1), (2301, [-1.0] * 16, 1),
    ]
    return rows


def test_equals_brute_force(spark):
    got = run(spark, awkward(), every=20)
    assert got == brute(awkward(), every=20) and len(got) > 100


def test_blocks_of_anchors_and_small_pieces(spark, monkeypatch):
    for name, value in (("ROWS", 16), ("SIDE", 3), ("FIRST", 2), ("ROWS_PER_TASK", 50)):
        monkeypatch.setattr(hn, name, value)
    assert run(spark, awkward(), every=20, anchors_per_block=4) == brute(awkward(), every=20)


def test_nothing_to_do(spark):
    assert run(spark, []) == []
    assert run(spark, vectors(2, 30), every=1000) == brute(vectors(2, 30), every=1000)
    assert run(spark, vectors(2, 30)[1:]) == []


@pytest.mark.parametrize("size", [1, 100, 10**4, 10**6, 10**7])
def test_scores_are_exact(size):
    r = np.random.default_rng(size)
    for width in (1, 3, 1024, 1025, 3000):
        a, b = r.integers(-size, size + 1, (5, width)), r.integers(-size, size + 1, (7, width))
        a[0], b[0], b[1] = size, size, -size
        bound = max(int((x.astype(object) ** 2).sum(1).max()) for x in (a, b))
        primes = primes_for(bound)
        got = products(residues(a, primes), residues(b, primes), primes)
        assert (got == a.astype(object) @ b.T.astype(object)).all()


def test_every_number_comes_back():
    primes = hn.PRIMES[:2]
    most = primes[0] * primes[1] // 4
    x = np.arange(-most, most + 1)
    rest = [hn.balanced((x % p).astype(np.float32), p)[None] for p in primes]
    assert (combine(rest, primes)[0] == x).all()


def test_too_large_scores_are_refused(spark):
    assert len(primes_for(2**60)) == 8
    with pytest.raises(ValueError):
        primes_for(2**63)
    with pytest.raises(ValueError):
        run(spark, [(100, [1e30], 1), (1, [1.0], 1)])
