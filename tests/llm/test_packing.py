import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanveil.llm.packing import best_fit, best_pattern, pack, plan, slots, solve
from tests.llm.helpers import corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_knapsack_against_brute_force():
    r = random.Random(1)
    for _ in range(40):
        lengths = np.array(sorted(r.sample(range(1, 20), 4)))
        weights = np.array([r.random() for _ in lengths])
        best = {0: 0.0}
        for c in range(1, 31):
            best[c] = max([best[c - 1], *(best[c - x] + w for x, w in zip(lengths.tolist(), weights) if x <= c)])
        found = best_pattern(lengths, weights, 30)
        assert sum(x * k for x, k in found) <= 30
        assert sum(weights[lengths.tolist().index(x)] * k for x, k in found) == pytest.approx(best[30])


def test_plan_packs_every_piece_once_and_tightly():
    r = random.Random(2)
    for capacity in (10, 64, 256):
        for _ in range(8):
            counts = {r.randint(1, capacity): r.randint(1, r.choice([3, 100, 5000])) for _ in range(60)}
            patterns = plan(counts, capacity)
            packed = Counter()
            for pattern, n in patterns:
                assert sum(x * k for x, k in pattern) <= capacity
                for x, k in pattern:
                    packed[x] += k * n
            assert packed == Counter(counts)
            used, plain = sum(n for _, n in patterns), sum(n for _, n in best_fit(counts, capacity))
            assert used <= 1.05 * plain + 1
            for x, rows in slots(patterns).items():
                assert rows[0, 0] == 0 and (np.diff(rows[:, 0]) > 0).all() and rows[-1, 0] < counts[x]
    assert plan({}, 10) == [] and solve({}, 10) == {}
    with pytest.raises(ValueError):
        plan({11: 1}, 10)


@pytest.mark.parametrize("group_rows", [200_000, 2])
def test_pack(spark, group_rows):
    t, ids = Tokenizer.from_file(PATH), defaultdict(list)
    for x in corpus():
        ids[x[0]].append(t.encode(x[1] or "", add_special_tokens=False).ids + [2])
    got = pack(frame(spark), PATH, capacity=64, group_rows=group_rows).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        if len(ids[r["doc_id"]]) == 1:
            own = ids[r["doc_id"]][0][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            assert r["piece"] == 0 or r["length"] == 64
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    total = sum(len(x) for v in ids.values() for x in v)
    assert sum(r["length"] for r in got) == total
    assert len(got) == sum(-(-len(x) // 64) for v in ids.values() for x in v)
    assert len(sequences) <= 1.03 * -(-total // 64) + 1


def test_pack_of_an_empty_table(spark):
    assert pack(frame(spark, []), PATH).count() == 0
