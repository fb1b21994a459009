"""Quality rules: base rules on one document, then lines that many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import SPACES, text_of, words_of
from spanveil.llm.lines import frequent_lines, normalised
from spanveil.plans.tables import stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8
A_SYMBOL = r"[#*$%&|<>]"
A_WORD = r"[^\x20\x09-\x0D]"


def _line_hash(line: Column) -> Column:
    """NULL for a line without a word."""
    return F.when(line != "", F.xxhash64(line))


def _line_hashes(text: Column) -> Column:
    return F.transform(F.split(normalised(text), "\n"), lambda x: _line_hash(F.btrim(x, F.lit(SPACES))))


def _measures(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The counts of each text; one projection for each step that a later one reads twice."""
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(A_WORD))
    step = rows.select(*keep, "body", words_of(F.col("body")).alias("words"), lines.alias("lines"))
    window = F.transform(  # slice() would copy the whole array for each window
        F.sequence(F.lit(0), F.size("words") - F.lit(WINDOW)),
        lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]),
    )
    step = step.select(
        *keep,
        "body",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.when(F.col("body").rlike(A_SYMBOL), F.length("body") - F.length(F.translate("body", SYMBOLS, "")))
        .otherwise(0).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > WINDOW, window).alias("hashes"),
    )
    kept = [c for c in step.columns if c != "hashes"]
    # only a text with a repeated window has its windows sorted
    some = F.size("hashes") > F.size(F.array_distinct("hashes"))
    step = step.select(
        *kept, F.when(some, F.sort_array(F.transform("hashes", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("sorted")
    )
    at = lambda i: F.get(F.col("sorted"), i)["h"]
    twice = F.filter("sorted", lambda x, i: (x["h"] == at(i - 1)).eqNullSafe(True) | (x["h"] == at(i + 1)).eqNullSafe(True))
    step = step.select(*kept, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("starts"))
    covered = F.aggregate(
        F.transform("starts", lambda x, i: F.least(F.lit(WINDOW), x - F.coalesce(F.get(F.col("starts"), i - 1), F.lit(-WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return step.select(*kept, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def _judged(
    docs: DataFrame,
    carried: Column,
    *,
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    line_share: float = 0.08,
    line_docs: int = 3,
    max_lost: float = 0.7,
) -> DataFrame:
    """``carried`` of each row with its counts and verdict."""
    rows = docs.select(carried.alias("carried"), F.col(host_col).cast("string").alias("host"), text_of(text_col).alias("body"))
    many = stored(frequent_lines(docs, host_col, text_col, _line_hashes, line_share, line_docs), "frequent-lines")
    step = _measures(rows, ["carried", "host"]).join(many.withColumnRenamed("host", "host_"), F.col("host").eqNullSafe(F.col("host_")), "left")
    # the lines of a text and their hashes stand at the same places
    hit = F.filter(
        F.zip_with(F.split("body", "\n"), _line_hashes(F.col("body")), lambda x, h: F.when(F.array_contains("lines", h), x)),
        lambda x: x.isNotNull(),
    )
    loses = F.aggregate(hit, F.lit(0).cast("long"), lambda a, x: a + F.size(words_of(x)))
    step = step.withColumn("removed_words", F.when(F.col("lines").isNull(), F.lit(0).cast("long")).otherwise(loses))
    bad = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    step = step.withColumn("base_failed", bad)
    kept = ~F.col("base_failed") & (F.col("removed_words") <= max_lost * F.col("n_words"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words"]
    stay = F.filter(
        F.zip_with(F.split("body", "\n"), _line_hashes(F.col("body")), lambda x, h: F.when(~F.coalesce(F.array_contains("lines", h), F.lit(False)), x)),
        lambda x: x.isNotNull(),
    )
    cleaned = F.when(F.col("removed_words") > 0, F.array_join(stay, "\n"))  # a line that goes has a word
    return step.select("carried", *names, kept.alias("kept"), cleaned.alias("cleaned"))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", with_text: bool = False, **options) -> DataFrame:
    """Counts and a verdict for each row; DataFrame functions only.

    ``options``: ``text_col``, ``host_col``, and the limits of :func:`_judged`.

    Lines are normalised (numbers folded, outer spaces dropped) and
    hashed; a line in at least ``line_docs`` distinct documents and more than
    ``line_share`` of the documents of its host is removed. A document that
    loses more than ``max_lost`` of its words that way is depleted. It is kept
    if the base rules hold and it isn't depleted.

    One row per row of ``docs``, with the id, ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``removed_words``, ``kept``, and ``with_text`` also ``cleaned``, the text
    without its removed lines, NULL where none is removed. NULL and empty texts have no words and fail.
    A NULL host is a host of its own. Repeated rows are judged alike and
    count as one document. Other columns are not read. An empty table gives
    an empty result.
    """
    judged = _judged(docs, F.col(id_col), **options)
    return (judged if with_text else judged.drop("cleaned")).withColumnRenamed("carried", id_col)


def keep_good(docs: DataFrame, *, clean: bool = False, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; no row moves. With ``clean``, removed lines go from their texts."""
    judged = _judged(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), **options)
    # a filter on the verdict would be pushed below the steps and repeat them all; one on an exploded row is not
    good = F.struct("carried", "cleaned") if clean else F.struct("carried")
    rows = judged.select(F.explode_outer(F.when(F.col("kept"), F.array(good))).alias("row")).where(F.col("row").isNotNull())
    if not clean:
        return rows.select("row.carried.*")
    text = options.get("text_col", "text").lower()
    own = [(c, F.col(f"row.carried.`{c}`")) for c in docs.columns]
    return rows.select(*[(F.coalesce("row.cleaned", x) if c.lower() == text else x).alias(c) for c, x in own])
