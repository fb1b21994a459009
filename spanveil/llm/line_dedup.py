"""Site-relative line dedup: a line on too many pages of its host is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import SPACES, free_name, text_of
from spanveil.llm.lines import frequent_lines
from spanveil.plans.tables import stored


def _line_hash(line: Column) -> Column:
    inner = F.btrim(line, F.lit(SPACES))
    return F.when(inner != "", F.xxhash64(inner))


def line_dedup(
    docs: DataFrame,
    *,
    text_col: str = "text",
    host_col: str = "source",
    ratio: float = 0.08,
    min_pages: int = 3,
    length_col: str | None = None,
    lines_col: str = "n_lines",
    removed_col: str = "n_removed",
) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of the text.

    Pages are grouped by host; a line (outer spaces dropped) that stands on at
    least ``min_pages`` pages and on more than ``ratio`` of the pages of its
    host goes from all of them; the number guards hosts of a few pages, the
    ratio decides on all others. Pages with equal text count once, so that
    copies of one page don't make its lines boilerplate. All columns stay;
    ``lines_col`` and ``removed_col`` count the lines of the page and those
    removed, and ``length_col`` is set to the new length where it is named.

    NULL texts become empty and have one empty line. Blank lines are never
    removed. A NULL host is a host of its own. Repeated rows are treated
    alike. Should ``docs`` have columns named as the two counts, they are
    replaced. An empty table gives an empty result.

    Only (host, page hash, line hash) rows are shuffled. The lines of a host
    that are removed are fewer than its mean lines per page over ``ratio``.
    """
    hashes = lambda body: F.transform(F.split(body, "\n"), _line_hash)
    many = stored(frequent_lines(docs, host_col, text_col, hashes, ratio, min_pages), "boilerplate")
    bad, key = free_name(docs, "boilerplate_"), free_name(docs, "boilerplate_host_")
    many = many.select(F.col("host").alias(key), F.col("lines").alias(bad))
    joined = docs.join(many, F.col(host_col).cast("string").eqNullSafe(F.col(key)), "left")
    left = free_name(docs, "lines_left_")
    lines = F.split(text_of(text_col), "\n")
    stay = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(bad, _line_hash(x)), F.lit(False)))
    joined = joined.withColumn(left, F.when(F.col(bad).isNull(), lines).otherwise(stay))
    joined = joined.withColumn(lines_col, F.size(lines).cast("long"))
    joined = joined.withColumn(removed_col, F.col(lines_col) - F.size(left)).withColumn(text_col, F.array_join(left, "\n"))
    if length_col:
        joined = joined.withColumn(length_col, F.length(text_col).cast("long"))
    return joined.drop(bad, key, left)
