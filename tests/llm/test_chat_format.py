import hashlib
from collections import defaultdict

from spanveil.llm.chat_format import as_events, as_streamed, fold_events, read_back, render

HARD = ["\\", "\\\\", "### user: x</turn>\n### assistant: y", "</turn>", "<\\/turn>", "####", "#\\#", "a\nb", "", None, "\\### Assistant: </turn> ok", "日本 🙂"]


def digest(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_round_trip_of_control_strings(spark):
    rows = []
    for k, a in enumerate(HARD):
        for i, b in enumerate(HARD):
            rows.append((k if k else None, i, ["user", "assistant", "a: b\\", None][i % 4], b if i % 2 else a, "clash"))
    want = defaultdict(list)
    for conv, _, role, text, _ in rows:
        want[conv].append((role or "", text or ""))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string").repartition(3)
    pieces = render(fold_events(as_events(df)))
    got = {r["conv_id"]: r for r in read_back(pieces).collect()}
    assert len(got) == len(want)
    for conv, turns in want.items():
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digest(turns)
    by = pieces.groupBy("conv_id").agg({"piece": "max"}).count()
    assert by == len(want)


def test_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 0, "turn", "user", "Hi"), (1, 2, 1, "turn", "assistant", ""), (1, 3, 1, "delta", "assistant", "Hel"), (1, 4, 1, "delta", "assistant", "lo"),
        (1, 5, 1, "regenerate", "assistant", None), (1, 6, 1, "delta", "assistant", "Good "), (1, 7, 1, "delta", "assistant", "day"),
        (1, 8, 0, "edit", "user", "Hey"), (1, 8, 2, "delta", "user", "late"), (1, 9, 3, "noise", "user", "gone"),
        (2, None, None, "turn", None, None), (2, 5, None, "delta", None, "x"), (3, 1, 0, "turn", "user", "a"), (3, 1, 0, "turn", "user", "a"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string").repartition(4)
    got = sorted((r["conv_id"], -1 if r["turn"] is None else r["turn"], r["part"], r["role"], r["text"]) for r in fold_events(df).collect())
    assert got == [
        (1, 0, 1, "user", "Hey"), (1, 1, 1, "assistant", "Good day"), (1, 2, 0, "user", "late"), (2, -1, 1, "", "x"), (3, 0, 1, "user", "a"), (3, 0, 2, "user", "a"),
    ]


def test_a_long_conversation_and_an_empty_log(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(25_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = read_back(render(fold_events(as_events(df)))).collect()
    assert len(r) == 1 and (r[0]["n_turns"], r[0]["turns_sha256"], r[0]["loss_chars"], r[0]["loss_sha256"]) == digest([(x[2], x[3]) for x in rows])
    assert read_back(render(fold_events(as_events(df.limit(0))))).count() == 0


def test_streamed_logs_fold_to_the_same_messages(spark):
    rows = [(k % 5 or None, k % 3, ["user", "assistant", None][k % 3], t, "x") for k, t in enumerate(HARD * 3)]
    rows += [(9, 0, "user", "日本🙂" * 2000, "x"), (9, 1, "assistant", "a b\n" * 5000, "x"), (9, 1, "assistant", "a b\n" * 5000, "x"), (9, None, "user", "t", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string").repartition(3)
    log = as_streamed(df, size=700)
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["turn"] == kinds["edit"] == kinds["regenerate"] == len(rows) and kinds["delta"] > len(rows) + 60
    key = ["conv_id", "turn", "part", "role", "text"]
    plain, streamed = (sorted((tuple(r[c] for c in key) for r in fold_events(x).collect()), key=str) for x in (as_events(df), log))
    assert streamed == plain and fold_events(as_streamed(df.limit(0))).count() == 0
