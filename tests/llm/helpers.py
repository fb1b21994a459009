"""Rows that every operator must stand: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words long, shard string, component_id long, start long, score double, piece int, id_ long, digest long, lines string"

WORDS = "thon inga ereth lystra mondel quarn être größe señal оно 字 zib! ok. (par) a's".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))


def corpus() -> list[tuple]:
    shared = prose(1, 40)
    texts = [
        None, "", " ", "\n\n", "one", "a b", prose(2, 5), prose(3, 60), prose(3, 60), prose(4, 200) + shared, shared + prose(5, 80),
        shared, "x" * 120, "x" * 49, "ab" * 60, prose(6, 3000), "same line\n" * 30, prose(7, 90).replace(" ", ""), "<|endoftext|> \x00 \\ ### </turn>",
        prose(8, 100), prose(8, 99) + "other", "a  b   c \n d", "éé" * 40, prose(1, 40)[:60],
    ]
    rows = [(i, x, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"host{i % 2}", None) for i, x in enumerate(texts)]
    rows += [(None, prose(3, 60), None, None, None), (None, None, None, None, None), (3, prose(3, 60), "en", "host1", 5), (8, prose(3, 60), "en", "host0", 5)]
    rows += [rows[9], rows[9], rows[0]]
    extra = (True, 7, "clash", 1, 2, 3.0, 4, 5, 6, "lines")
    return [x + extra for x in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)


def bare(rows) -> list[tuple]:
    return sorted((tuple(x) for x in rows), key=str)
