r"""Chat formatting from event logs.

A log holds one row per event: ``turn`` opens a message, ``delta`` appends to
it, ``edit`` replaces its text, ``regenerate`` throws its text away. Events
are sorted by sequence and folded into final messages, which are rendered as

    ### role: text</turn>

Inside texts and roles a backslash is doubled, one is put between two number
signs and into ``</``, and a colon of a role gets one, so that a header or an
end mark never occurs inside; taking away each backslash that escapes undoes it.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("turn", "regenerate", "edit", "delta")
END = "</turn>\n"
TURN = re.compile(r"### ((?:[^:\\]|\\.)*): (.*?)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
FORMATTED = (
    "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def as_events(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Finished turns as a log in which each row opens a message."""
    return rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("seq"), F.col(turn_col).cast("long").alias("turn"),
        F.lit("turn").alias("kind"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )


DELTA = 1024  # code points of a delta


def as_streamed(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", size: int = DELTA
) -> DataFrame:
    """Finished turns as the log of a conversation that was streamed.

    Each row opens a message with a draft, which grows by a delta, is edited
    and thrown away; then its own text comes in deltas of ``size`` code
    points. Folding gives the rows again: no draft is left.

    Rows of one turn follow each other whole, by role and text. NULL and empty
    texts have no delta of their own.
    """
    named = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    of_turn = Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    draft = F.concat(F.lit("draft of "), F.left(F.coalesce("text", F.lit("")), F.lit(40)))
    said = F.transform(
        F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{size}}}+"), F.lit(0)), lambda x: event("delta", x)
    )
    before = F.array(event("turn", draft), event("delta", F.lit(" and more")), event("edit", draft), event("regenerate", F.lit(None)))
    log = named.withColumn("row", F.row_number().over(of_turn)).select("conv_id", "turn", "role", "row", F.posexplode(F.concat(before, said)).alias("i", "e"))
    # a message has fewer than 2 ** 31 code points, and so fewer events
    seq = F.col("row").cast("long") * F.lit(1 << 32) + F.col("i")
    return log.select("conv_id", seq.alias("seq"), "turn", "e.kind", "role", "e.text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, turn, part, role, text`` of a log
    ``conv_id, seq, turn, kind, role, text``.

    ``delta``, ``edit`` and ``regenerate`` change the message that was opened
    last under their turn; without one they open it. Several ``turn`` events
    under one turn stay separate messages (``part``). Equal sequence numbers
    are ordered by kind (turn, regenerate, edit, delta), role, text. The first
    role of a message holds. NULL texts and roles count as empty, NULL
    conversations, turns and sequence numbers come first and are values of
    their own; rows of another kind are left out. Repeated rows are repeated
    events. An empty log gives no message.

    Work is dealt out by conversation and turn, so a conversation of any
    length is spread; what one task holds at once is one message.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    log = events.select("conv_id", "seq", "turn", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = log.where(F.col("kind").isin(*KINDS)).withColumn("rank", rank)
    order = Window.partitionBy("conv_id", "turn").orderBy("seq", "rank", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log = log.select(
        "conv_id", "turn", "role", "text", F.row_number().over(order).alias("n"),
        F.sum((F.col("kind") == "turn").cast("long")).over(upto).alias("part"),
        F.sum((F.col("kind") != "delta").cast("long")).over(upto).alias("version"),
    )
    whole = Window.partitionBy("conv_id", "turn", "part")
    log = log.withColumn("last", F.max("version").over(whole)).withColumn("first_role", F.min_by("role", F.when(F.col("role") != "", F.col("n"))).over(whole))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    final = log.where(F.col("version") == F.col("last")).groupBy("conv_id", "turn", "part")
    return final.agg(F.coalesce(F.first("first_role"), F.lit("")).alias("role"), F.array_join(texts, "").alias("text"))


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(doubled, "#(?=#)", r"#\\"), F.lit("</"), F.lit("<\\/"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One formatted piece per message; the pieces of a conversation in order
    of ``turn, part`` are its formatted text. ``loss_from`` and ``loss_to``
    bound the text under the loss mask in code points of the piece, NULL where
    there is none."""
    head = F.concat(F.lit("### "), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    rows = messages.select("conv_id", "turn", "part", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    mine, start = F.col("role") == loss_role, F.length("head")
    return rows.select(
        "conv_id", "turn", "part", F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(mine, start).alias("loss_from"), F.when(mine, start + F.length("body")).alias("loss_to"),
    )


def _digest(batches):
    """Conversations arrive in order, over any number of batches; a batch is all that is held."""
    state = None

    def row():
        key, turns, said, chars, loss, length = state
        return key, turns, said.hexdigest(), chars, loss.hexdigest(), length

    def table(rows, schema_of):
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        types = (schema_of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    kind = None
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for key, piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_from", "loss_to"))):
            if state is None or state[0] != key:
                if state is not None:
                    out.append(row())
                state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in TURN.findall(piece):
                state[1] += 1
                state[2].update(f"{ESCAPED.sub(r'\1', role)}\n{ESCAPED.sub(r'\1', text)}\n".encode())
            if start is not None:
                text = ESCAPED.sub(r"\1", piece[start:end])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(piece)
        if out:
            yield table(out, kind)
    if state is not None:
        yield table([row()], kind)


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted pieces alone: the turns
    parsed, unescaped and hashed (role, line feed, text, line feed), and the
    text under the loss mask. A NULL conversation is one of its own; no piece,
    no row. The hashes are running ones: a conversation of any length passes
    in order without being held."""
    kind = dict(pieces.dtypes)["conv_id"]
    ordered = pieces.select("conv_id", "turn", "part", "piece", "loss_from", "loss_to").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "turn", "part").mapInArrow(_digest, FORMATTED.format(kind))
