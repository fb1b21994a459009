import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from spanveil.llm.line_dedup import line_dedup
from spanveil.llm.quality_rules import keep_good, quality_rules
from tests.llm.helpers import bare, corpus, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def frequent(rows, clean, share, least):
    """Brute force: per host, lines in so many of its distinct texts."""
    texts = defaultdict(set)
    for row in rows:
        texts[row[3]].add(row[1] or "")
    out = {}
    for host, own in texts.items():
        n = Counter(x for t in own for x in {clean(y) for y in t.split("\n")} if x)
        out[host] = {x for x, c in n.items() if c >= least and c > share * len(own)}
    return out


def rules(rows, share, least, lost):
    clean = lambda x: re.sub("[0-9]+", "0", x).strip(SPACES)
    many, out = frequent(rows, clean, share, least), []
    for row in rows:
        text = row[1] or ""
        words = WORD.findall(text)
        where = defaultdict(list)
        for i in range(len(words) - 7):
            where[tuple(words[i : i + 8])].append(i)
        covered = {i + k for s in where.values() if len(s) > 1 for i in s for k in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        gone = sum(len(WORD.findall(x)) for x in text.split("\n") if clean(x) in many[row[3]])
        bad = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in text)
        out.append((row[0], len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), bad, gone, not bad and gone <= lost * len(words)))
    return out


def more_rows():
    footer = "All rights kept 2019, see the terms of this place"
    rows = corpus()
    extra = rows[0][5:]
    for i in range(30):
        rows.append((100 + i, f"{prose(50 + i, 25)}\n{footer.replace('2019', str(2000 + i))}\n {footer} ", "en", "host2" if i < 25 else None, None, *extra))
    for i in range(12):
        rows.append((200 + i, f"{footer}\n{footer} more of it and still more of the same\nx{i} y", "en", "host2", None, *extra))
    return rows


def test_rules_against_brute_force(spark):
    rows = more_rows()
    got = quality_rules(frame(spark, rows), line_share=0.2, line_docs=5, max_lost=0.5)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]
    assert bare(got.collect()) == bare(rules(rows, 0.2, 5, 0.5))


def test_keep_good_keeps_whole_rows(spark):
    rows = more_rows()
    want = [r for r, v in zip(rows, rules(rows, 0.08, 3, 0.7)) if v[-1]]
    assert want and bare(keep_good(frame(spark, rows)).collect()) == bare(want)


def test_stage_removes_the_lines_that_the_rules_remove(spark):
    """The footer's year differs in each document, so only the normalised lines agree."""
    rows = [r for r in more_rows() if r[0] is not None]
    clean = lambda x: re.sub("[0-9]+", "0", x).strip(SPACES)
    many = frequent(rows, clean, 0.08, 3)
    text = lambda r: "\n".join(x for x in (r[1] or "").split("\n") if clean(x) not in many[r[3]])
    want = [(r[0], text(r), len(text(r))) for r, v in zip(rows, rules(rows, 0.08, 3, 0.7)) if v[-1]]
    got = corpus_pipeline.quality(spark, frame(spark, rows), "")
    assert got.columns == frame(spark).columns and sum("All rights" in r[1] for r in rows if r[1]) > 30
    assert bare(got.select("doc_id", "text", "n_chars").collect()) == bare(want) and not any("All rights" in x[1] and x[0] in range(100, 125) for x in want)
    mine = {r["doc_id"]: r["cleaned"] for r in quality_rules(frame(spark, rows), with_text=True).collect()}
    assert all(mine[k] in (t, None) for k, t, _ in want if 100 <= k < 130) and mine[100] is not None


def test_rules_of_an_empty_table(spark):
    assert quality_rules(frame(spark, [])).count() == 0 and keep_good(frame(spark, [])).columns == frame(spark).columns


def test_rules_use_no_python(spark):
    plan = quality_rules(frame(spark).drop("lines"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_line_dedup_against_brute_force(spark):
    rows = more_rows()
    many = frequent(rows, lambda x: x.strip(SPACES), 0.2, 5)
    want = []
    for row in rows:
        lines = (row[1] or "").split("\n")
        left = [x for x in lines if x.strip(SPACES) not in many[row[3]]]
        want.append((row[0], "\n".join(left), len(lines), len(lines) - len(left)))
    got = line_dedup(frame(spark, rows), ratio=0.2, min_pages=5)
    assert any(x[3] for x in want)
    assert bare(got.select("doc_id", "text", "n_lines", "n_removed").collect()) == bare(want)
    assert set(frame(spark).columns) < set(got.columns)


def test_line_dedup_sets_the_length_and_takes_empty_tables(spark):
    got = line_dedup(frame(spark, more_rows()), length_col="n_chars")
    assert got.where(F.col("n_chars") != F.length("text")).count() == 0
    assert line_dedup(frame(spark, [])).count() == 0


def test_copies_of_a_page_make_no_boilerplate(spark):
    rows = [(i, "first line\nsecond line", "en", "h", None, *corpus()[0][5:]) for i in range(40)]
    assert line_dedup(frame(spark, rows)).where("n_removed > 0").count() == 0


def test_limits_hold_on_hosts_of_any_size(spark):
    """With the defaults: a line on a tenth of a host's pages goes, on three pages at least; one on two pages stays."""
    footer, extra, rows = "Printed by the press of this house, all rights with it", corpus()[0][5:], []
    for host, n in (("nine", 9), ("fifty", 50), ("many", 500)):
        shared = max(3, n // 10)
        for k in range(n):
            text = prose(n * 1000 + k, 40).replace("\n", " ")
            text += f"\n{footer}" if k < shared else "\nA line of two pages only" if k < shared + 2 else ""
            rows.append((len(rows), text, "en", host, None, *extra))
    removed = {r["doc_id"]: r["n_removed"] for r in line_dedup(frame(spark, rows)).collect()}
    judged = {r["doc_id"]: r["removed_words"] for r in quality_rules(frame(spark, rows)).collect()}
    for r in rows:
        assert removed[r[0]] == (footer in r[1]) and judged[r[0]] == 11 * (footer in r[1])


def test_the_verdict_is_more_than_the_base_rules(spark):
    """Documents of little but boilerplate pass the base rules and are rejected."""
    extra, line = corpus()[0][5:], " ".join(f"word{k}" for k in range(30))
    rows = [(k, f"{line.replace('word1 ', 'wordé ')}\n{prose(k, 3)} {k}", "en", "h", None, *extra) for k in range(20)]
    rows += [(100 + k, prose(900 + k, 60), "en", "h", None, *extra) for k in range(20)]
    got = {r["doc_id"]: r for r in quality_rules(frame(spark, rows)).collect()}
    assert all(not got[k]["base_failed"] and not got[k]["kept"] for k in range(20)) and all(got[100 + k]["kept"] for k in range(20))
