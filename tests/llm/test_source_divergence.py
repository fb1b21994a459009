import re
from collections import Counter, defaultdict

import pytest

from spanveil.llm import source_divergence as sd
from spanveil.llm.source_divergence import source_divergence
from tests.llm.helpers import bare, corpus, frame, prose


def brute(rows, least=10, ranks=10):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        found = terms(r[1])
        groups[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {x for x, _ in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        sources = sorted((s for g, s in groups if g == lang), key=str.encode)

        def share(counts):
            n = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // n for t in kept}

        p = {s: share(groups[lang, s]) for s in sources}
        q = share(sum((groups[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            apart = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(apart)[:ranks], 1)]
    return bare(out)


def got(df, **more):
    return bare(tuple(r) for r in source_divergence(df, **more).collect())


def rows():
    out = corpus()
    clash = out[0][4:]
    for k in range(120):
        out.append((1000 + k, prose(k % 70, 30 + k) + " ÄÖÜ\x7fFoo\x00bar KK" * (k % 3), "de" if k % 4 == 0 else "en", f"host{k * k % 11}") + clash)
    out += [(2000 + k, "12 34 .", "xx", "nothing" + str(k % 2)) + clash for k in range(12)]  # no terms
    out += [(2100 + k, "rare words", "yy", "few") + clash for k in range(9)]  # under ten documents
    out += [(2200 + k, "lone " * (k + 1), "zz", "lone") + clash for k in range(10)]
    out += [(2300, "12", "en", "no terms here") + clash, (2301, "long " * 200_000, "en", "long") + clash]
    return out


def test_equals_brute_force(spark):
    found = got(frame(spark, rows()))
    assert found == brute(rows()) and {x[2] for x in found} == {"pair", "term"}


def test_slices_blocks_and_tiles(spark, monkeypatch):
    for name, value in (("TERMS_PER_BLOCK", 5), ("SOURCES_PER_TILE", 3), ("PAIRS_HELD", 8)):
        monkeypatch.setattr(sd, name, value)
    assert got(frame(spark, rows()), slice_terms=7, ranks=3, least_docs=3) == brute(rows(), 3, 3)


@pytest.mark.parametrize("data", [[], [corpus()[0]], [corpus()[7]] * 10])
def test_little(spark, data):
    assert got(frame(spark, data)) == brute(data)


def test_terms_are_cut_by_bytes(monkeypatch):
    import random

    import pyarrow as pa

    r = random.Random(2)
    bits = ["a", "Z", "É", "ß", "字", "😀", " ", "1", "@", "[", "`", "{", "\x7f", "\x00", "\x80", "ab", "  "]
    texts = ["", "A", "é", *("".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(400)), "x" * 500, "", "end"]
    want = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    for window, probe in ((1 << 20, 3), (7, 0), (64, 1)):
        monkeypatch.setattr(sd, "WINDOW", window)
        monkeypatch.setattr(sd, "PROBE", probe)
        whole = pa.array(texts)
        for array, mine in ((whole, want), (whole.slice(3, 50), want[3:53]), (whole.slice(0, 0), [])):
            terms, hashes = sd.cut(array)
            assert terms.to_pylist() == [" ".join(x) for x in mine]
            if probe == 0:
                pairs = {(t, h) for a, b in zip(mine, hashes.to_pylist()) for t, h in zip(a, b, strict=True)}
                assert len(pairs) == len({t for t, _ in pairs}) == len({h for _, h in pairs})
