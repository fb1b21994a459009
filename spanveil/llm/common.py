"""What the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"  # the six characters that end a word
WORD_GAP = r"[\x20\x09-\x0D]+"


def text_of(col: str) -> Column:
    """The text as a string, NULL as the empty one."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text; none of a text without any."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def sent_if_small(table: DataFrame, most: int = 500_000) -> DataFrame:
    """A stored table of a few narrow columns, to be broadcast if it has at most ``most`` rows, else to be shuffled."""
    return F.broadcast(table) if table.count() <= most else table
