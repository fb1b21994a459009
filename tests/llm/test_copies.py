import hashlib
import random

import numpy as np
import pytest
import xxhash

from spanveil.llm import bwt
from spanveil.llm.bktree import near
from spanveil.llm.components import components
from spanveil.llm.simhash_dedup import near_duplicates, one_of_each
from spanveil.llm.suffix_dedup import ANCHOR, _merge, anchors, substring_dedup
from tests.llm.helpers import bare, corpus, frame, prose


def groups_of(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_bk_trees_find_all_pairs():
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = [b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) for b in base for _ in range(25)]
    tree = np.array(sorted(r.randrange(3) for _ in prints))
    spread = [list(dict.fromkeys(x for x, t in zip(prints, tree) if t == k)) for k in range(3)]
    tree = np.concatenate([[k] * len(x) for k, x in enumerate(spread)]).astype(np.int64)
    flat = np.array([x for s in spread for x in s], np.uint64)
    for radius in (0, 1, 3, 6):
        got = {(a, b) for x, y in near(flat, tree, radius) for a, b in zip(x.tolist(), y.tolist())}
        want = {(a, b) for a in range(len(flat)) for b in range(a) if tree[a] == tree[b] and (int(flat[a]) ^ int(flat[b])).bit_count() <= radius}
        assert got == want
    assert list(near(flat[:0], tree[:0], 3)) == []


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(70, 200), r.randrange(70, 200)) for _ in range(80)] + [(5, 5)]
    want = groups_of(200, links)
    got = {x["a"]: x["b"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(200))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def print_of(text, words):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_rows():
    rows, extra = corpus(), corpus()[0][5:]
    for k in range(40):
        text = prose(300 + k // 4, 120).split(" ")
        text[k % 4 * 7] = f"changed{k}"
        rows.append((500 - k, " ".join(text), "en", "host1", None, *extra))
    return rows


@pytest.mark.parametrize("large", [4096, 1])
def test_near_duplicates_against_brute_force(spark, large):
    rows = near_rows()
    prints = [print_of(x[1], 3) for x in rows]
    root = groups_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {k: min((x[0] for x, y in zip(rows, root) if y == k and x[0] is not None), default=None) for k in set(root)}
    got = near_duplicates(frame(spark, rows), words=3, large=large)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert bare(got.collect()) == bare((x[0], f"{p:016x}", least[k]) for x, p, k in zip(rows, prints, root))
    assert len(set(root)) < len(set(prints))


def test_one_of_each(spark):
    rows = near_rows()
    kept = one_of_each(frame(spark, rows), words=3).collect()
    ids = [x["doc_id"] for x in kept if x["doc_id"] is not None]
    found = near_duplicates(frame(spark, rows), words=3).collect()
    assert sorted(ids) == sorted({x[0] for x in found if x[0] is not None and x[0] == x[2]})
    assert sum(x["doc_id"] is None for x in kept) == sum(x[0] is None for x in rows)
    assert near_duplicates(frame(spark, [])).count() == 0 and one_of_each(frame(spark, [])).count() == 0


def test_interval_expansion_groups_equal_strings():
    r = random.Random(4)
    for _ in range(150):
        length, letters = r.choice([1, 2, 5, 8, 9, 13, 50]), r.choice([2, 3, 200])
        parts = [bytes(r.randrange(letters) for _ in range(r.randint(1, 80))) for _ in range(r.randint(1, 8))]
        parts += [r.choice(parts) + b"\x01" for _ in range(3)]
        raw = b"\xff".join(parts) + b"\xff"
        places, group = bwt.shared(np.frombuffer(raw, np.uint8), length)
        strings = {}
        for p, g in zip(places.tolist(), group.tolist()):
            x = raw[p : p + length]
            if len(x) == length and 255 not in x:
                strings.setdefault(x, set()).add(g)
        assert all(len(g) == 1 for g in strings.values())
        assert len({min(g) for g in strings.values()}) == len(strings)
    assert len(bwt.shared(np.zeros(0, np.uint8), 5)[0]) == 0


def test_anchors_of_equal_strings_are_equal():
    text = prose(9, 300).encode()
    doc, first, last, hashes = anchors([text, b"short", b"", b"before " + text[40:400] + b" after"], 50)
    assert set(doc.tolist()) == {0, 3} and sum((last - first + 1)[doc == 0]) == len(text) - 49
    at = lambda d, s: hashes[(doc == d) & (first <= s) & (s <= last)][0]
    assert all(at(0, 40 + s) == at(3, 7 + s) for s in range(0, 311))
    assert len(anchors([], 50)[0]) == 0 and ANCHOR < 50
    d, a, b = _merge(np.array([1, 0, 0, 0]), np.array([0, 10, 0, 4]), np.array([5, 12, 5, 10]))
    assert (d.tolist(), a.tolist(), b.tolist()) == ([0, 1], [0, 0], [12, 5])


def removed(rows, length):
    first = {}
    bodies = [(x[1] or "").encode() for x in rows]
    for x, b in zip(rows, bodies):
        for i in range(len(b) - length + 1 if x[0] is not None else 0):
            w = b[i : i + length]
            first[w] = min(first.get(w, x[0]), x[0])
    for x, b in zip(rows, bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1 if x[0] is not None else 0):
            if first[b[i : i + length]] < x[0]:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield x[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("options", [{}, {"part_bytes": 2000, "bucket_bytes": 3000, "block_bytes": 1000, "hot_docs": 1}])
def test_substring_dedup_against_brute_force(spark, options):
    rows, extra = near_rows(), corpus()[0][5:]
    rows += [(700 + k, prose(77, 12)[:70] + prose(400 + k, 20), "en", "host1", None, *extra) for k in range(30)]
    want = list(removed(rows, 50))
    got = substring_dedup(frame(spark, rows), with_text=True, **options).collect()
    assert bare((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == bare(want)
    assert sum(x[2] for x in want) > 1000
    assert all(len(r["kept"]) == r["n_bytes"] - sum(b - a for a, b in zip(r["starts"], r["stops"])) for r in got)


def test_substring_dedup_of_an_empty_table(spark):
    assert substring_dedup(frame(spark, [])).count() == 0
