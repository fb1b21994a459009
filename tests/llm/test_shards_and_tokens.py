import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanveil.llm import simple8b
from spanveil.llm.shard_placement import fill, place
from spanveil.llm.token_files import read_token_files, write_token_files
from spanveil.llm.tokens import encoder
from spanveil.plans.tables import fresh_path
from tests.llm.helpers import bare, corpus, frame, prose


def test_fill_is_even_and_few_slots_move():
    names = [f"s{k}" for k in range(20)]
    owner = fill(names)
    sizes = np.bincount(owner, minlength=20)
    assert sizes.max() - sizes.min() <= 1
    fewer = fill(names[:-1])
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 19)
    assert moved < 0.12 * len(owner)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            fill(bad)
    with pytest.raises(ValueError):
        fill(["a"], 4098)


def test_placement(spark):
    df = frame(spark)
    got = place(df, F.col("doc_id"), ["a", "b", "c"], slots=101)
    assert got.count() == df.count() and got.where("shard is null or slot is null").count() == 0
    assert got.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan
    assert place(df.limit(0), F.col("doc_id"), ["a"]).count() == 0


def test_simple8b_round_trip():
    r = random.Random(5)
    for n in (0, 1, 2, 59, 60, 61, 239, 240, 241, 4095, 4096, 4097, 9000):
        for bits in (0, 1, 3, 16, 17, 31, 60, 61, 64):
            ids = np.array([r.getrandbits(r.randint(1, bits)) if bits else 0 for _ in range(n)], np.uint64)
            data = simple8b.encode(ids)
            assert (simple8b.decode(data) == ids).all() and len(simple8b.decode(data)) == n
            if n > 4096:
                assert (simple8b.decode(data, 1, 1) == ids[4096:8192]).all()
    assert len(simple8b.encode(np.zeros(4096, np.uint64))) < 250


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    r = random.Random(3)
    bits = ["a", "B", " ", "  ", "\n", "\t", "é", ".", "1", "'s", " ", " ", "<|endoftext|>", "́", "ß", "İ", "ſ", "word", "²", "\x1c", "%%"]
    texts = ["", " ", "a  b", "trail ", "x\n ", *("".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(2000)), prose(3, 4000)]
    for text, ids in zip(texts, encoder(path).ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t, out = Tokenizer.from_file(path), fresh_path(spark, "ids")
    write_token_files(frame(spark), out, path)
    got = read_token_files(spark, out).orderBy("start").collect()
    want = sorted((x[0], x[1] or "") for x in corpus() if x[0] is not None)
    texts = {}
    for doc, text in [(x[0], x[1] or "") for x in corpus()]:
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [2], "<u4")
        texts.setdefault(doc, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [x["doc_id"] for x in got][2:] == [x[0] for x in want] and len(got) == len(corpus())
    at = 0
    for x in got:
        assert x["start"] == at
        at += x["n_tokens"]
    assert bare((x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in got) == bare((d, n, c) for d, v in texts.items() for n, c in v)
    out = fresh_path(spark, "ids")
    write_token_files(frame(spark, []), out, path)
    assert read_token_files(spark, out).count() == 0
