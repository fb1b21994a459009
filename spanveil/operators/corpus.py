"""Reports over a whole corpus: classify, link, compare, check.

They take documents with a ``spans`` column whose spans carry their ``text``
(``analyze(..., with_text=True)``), one row per document. Each document is
condensed where it lies; only small rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.arrays import bind, groups, let
from spanveil.functions.spans import inside, merge_overlaps, surfaces
from spanveil.operators.phrases import PhraseTable, hit_rows, joined_hits

ALL = "ALL"
# Parts over which one value's documents are spread when they are linked.
SALTS = 128


def default_normal(value: Column) -> Column:
    return F.lower(F.trim(value))


def counted(keys: Column) -> Column:
    """Distinct elements of an array with their counts, as ``array<struct<key,n>>``."""
    new = "_p = 0 OR get(_k, _p) <> get(_k, _p - 1)"
    one = "named_struct('key', get(_k, _first), 'n', cast(_last - _first + 1 AS bigint))"
    return bind(keys, let("array_sort(v)", "_k", groups("_k", new, one)))


def _per_type(spans: Column) -> Column:
    """A document's spans and scores by entity type, and of type ``ALL``; NULL for a document without spans."""

    def one(name: Column, part: Column) -> Column:
        total = F.aggregate(part, F.lit(0.0), lambda a, s: a + s["score"])
        return F.struct(name.alias("entity_type"), F.size(part).alias("n"), total.alias("score"))

    per_type = F.transform(
        F.array_distinct(F.transform(spans, lambda s: s["entity_type"])),
        lambda name: one(name, F.filter(spans, lambda s: s["entity_type"].eqNullSafe(name))),
    )
    return F.when(F.size(spans) > 0, F.concat(per_type, F.array(one(F.lit(ALL), spans))))


def entity_summary(df: DataFrame, by: str | Iterable[str], spans_col: str = "spans") -> DataFrame:
    """Spans, documents and mean score per entity type and value of ``by``.

    Type ``ALL`` counts documents with any span. ``by`` is one dimension or
    several: with several there is a row for every combination of dimensions,
    those left out being totals. ``level`` tells totals from values that are
    NULL: a bit for each dimension, the last one lowest, set where the row is
    a total over it (so 0 is the finest).
    """
    dims = [by] if isinstance(by, str) else list(by)
    if not 0 < len(dims) <= 10:
        raise ValueError("one to ten dimensions, please")
    rows = (
        df.select(*dims, F.explode_outer(_per_type(F.col(spans_col))).alias("_t"))
        .where(F.col("_t").isNotNull())
        .select(*dims, "_t.*")
    )
    sets = [["entity_type", *[d for k, d in enumerate(dims) if not bits >> (len(dims) - 1 - k) & 1]] for bits in range(1 << len(dims))]
    return (
        rows.groupingSets(sets, "entity_type", *dims)
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.sum("n").alias("spans"),
            F.count(F.lit(1)).alias("documents"),
            F.round(F.sum("score") / F.sum("n"), 6).alias("mean_score"),
        )
    )


# Registers of a sketch are 2 ** SKETCH_BITS: a standard error of about 1.6 %.
SKETCH_BITS = 12


def entity_sketches(df: DataFrame, id_col: str, by: str | Iterable[str], spans_col: str = "spans") -> DataFrame:
    """Per entity type and dimensions: spans, and sketches of distinct documents and values.

    Rows of several days, or of several corpora, are merged by
    :func:`merge_sketches`; what is kept of a day does not grow with it.
    """
    dims = [by] if isinstance(by, str) else list(by)
    values = F.transform(F.col(spans_col), lambda s: F.struct(s["entity_type"].alias("entity_type"), default_normal(s["text"]).alias("value")))
    rows = df.select(*dims, F.col(id_col).cast("string").alias("_id"), F.explode_outer(counted(values)).alias("_v"))
    rows = rows.where(F.col("_v").isNotNull()).select(*dims, "_id", "_v.key.entity_type", "_v.key.value", "_v.n")
    return rows.groupBy("entity_type", *dims).agg(
        F.sum("n").alias("spans"), F.hll_sketch_agg("_id", SKETCH_BITS).alias("documents"), F.hll_sketch_agg("value", SKETCH_BITS).alias("values")
    )


def merge_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of finer rows as those of coarser ones (``entity_type`` and ``by``)."""
    return sketches.groupBy("entity_type", *by).agg(
        F.sum("spans").alias("spans"), F.hll_union_agg("documents").alias("documents"), F.hll_union_agg("values").alias("values")
    )


def read_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches as estimated numbers of distinct documents and values."""
    return sketches.withColumns({c: F.hll_sketch_estimate(c) for c in ("documents", "values")})


def score_histogram(df: DataFrame, spans_col: str = "spans") -> DataFrame:
    """Spans per entity type and score bucket of a tenth (lower bound)."""
    rows = df.select(F.explode_outer(spans_col).alias("_s")).where(F.col("_s").isNotNull())
    bucket = F.floor(F.col("_s.score") * 10 + 1e-9) / 10
    return rows.groupBy(F.col("_s.entity_type").alias("entity_type"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("spans")
    )


def doc_values(
    df: DataFrame,
    id_col: str,
    spans_col: str = "spans",
    normal: Callable[[Column], Column] = default_normal,
) -> DataFrame:
    """``<id, entity_type, value, n>``: the distinct values of every document.

    ``value`` is the SHA-256 of the normal form, as bytes. Write this table
    once and link from it: the link reports read it more than once.
    """
    keys = F.transform(
        F.col(spans_col),
        lambda s: F.struct(
            s["entity_type"].alias("entity_type"), F.unhex(F.sha2(normal(s["text"]), 256)).alias("value")
        ),
    )
    rows = df.select(
        F.col(id_col), F.explode_outer(counted(keys)).alias("_v")
    ).where(F.col("_v").isNotNull())
    return rows.select(id_col, "_v.key.entity_type", "_v.key.value", F.col("_v.n").alias("n"))


def _hash_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def link_values(values: DataFrame, id_col: str) -> DataFrame:
    """Every value with its documents, occurrences and first document."""
    return (
        values.groupBy("entity_type", "value")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.sum("n").alias("occurrences"),
            F.min(id_col).alias("first_document"),
        )
        .select(
            "entity_type", _hash_text(F.col("value")).alias("value_hash"), "documents", "occurrences", "first_document"
        )
    )


def top_values(values: DataFrame, id_col: str, k: int) -> DataFrame:
    """The ``k`` values found in most documents."""
    return link_values(values, id_col).orderBy(
        F.desc("documents"), F.desc("occurrences"), "entity_type", "value_hash"
    ).limit(k)


def link_documents(values: DataFrame, id_col: str, salts: int = SALTS) -> DataFrame:
    """Documents that share values, as ``<hub, id, shared_values>``.

    Every value links its documents to the first one that has it (the hub),
    so a value in n documents makes n - 1 links and not n * n; all documents
    of a value stay connected. A value that is everywhere is spread over
    ``salts`` parts, and only over those in which it occurs.
    """
    key = ["entity_type", "value"]
    salted = values.select(id_col, *key, F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int").alias("_salt"))
    parts = salted.groupBy(*key, "_salt").agg(F.min(id_col).alias("hub"), F.count(F.lit(1)).alias("n"))
    hubs = (
        parts.groupBy(*key)
        .agg(F.min("hub").alias("hub"), F.sum("n").alias("n"), F.collect_list("_salt").alias("_salts"))
        .where(F.col("n") > 1)
        .select(*key, "hub", F.explode("_salts").alias("_salt"))
    )
    edges = salted.join(hubs, [*key, "_salt"]).where(F.col(id_col) != F.col("hub"))
    return edges.groupBy("hub", id_col).agg(F.count(F.lit(1)).alias("shared_values"))


def type_sets(df: DataFrame, spans_col: str = "spans") -> DataFrame:
    """Which entity types occur together: documents per set of types.

    Documents without spans are dropped after counting, by an aggregate: a
    filter on the array would be pushed down and detect everything twice.
    """
    types = F.array_sort(F.array_distinct(F.transform(F.col(spans_col), lambda s: s["entity_type"])))
    return (
        df.groupBy(types.alias("types"))
        .agg(F.count(F.lit(1)).alias("documents"), F.max(F.size(spans_col)).alias("_spans"))
        .where(F.col("_spans") > 0)
        .drop("_spans")
    )


def type_cooccurrence(df: DataFrame, entity_types: Iterable[str], spans_col: str = "spans") -> DataFrame:
    """Documents in which two entity types both occur, as a matrix.

    One row per type, one column per type. Documents are first counted by
    their set of types; the matrix is made from those few rows.
    """
    wanted = list(entity_types)
    sets = type_sets(df, spans_col)
    rows = sets.select("types", "documents", F.explode_outer("types").alias("entity_type"))
    return (
        rows.where(F.col("entity_type").isin(*wanted))
        .groupBy("entity_type")
        .agg(
            *[
                F.sum(F.when(F.array_contains("types", t), F.col("documents")).otherwise(0)).alias(t)
                for t in wanted
            ]
        )
    )


def frequency_change(df: DataFrame, text_col: str, spans_col: str = "spans", items_col: str = "items") -> DataFrame:
    """Whether anonymization kept the frequency profile of the values.

    Per entity type: distinct values before and after, and the largest
    difference between the numbers of values that occur equally often. Zero
    means that the histogram of frequencies is the same, as hashing leaves it.
    """
    text = F.col(text_col)
    islands = surfaces(text, merge_overlaps(inside(F.col(spans_col), text)), ["entity_type"])

    def side(values: Column, after: bool) -> Column:
        return F.transform(
            values,
            lambda v: F.struct(
                v["entity_type"].alias("entity_type"),
                F.lit(after).alias("after"),
                F.unhex(F.sha2(v["text"], 256)).alias("value"),
            ),
        )

    both = F.concat(side(islands, False), side(F.col(items_col), True))
    rows = df.select(F.explode_outer(both).alias("_v")).where(F.col("_v").isNotNull()).select("_v.*")
    counts = rows.groupBy("entity_type", "after", "value").agg(F.count(F.lit(1)).alias("n"))
    histogram = counts.groupBy("entity_type", "n").agg(
        F.sum(F.when(F.col("after"), 0).otherwise(1)).alias("b"),
        F.sum(F.when(F.col("after"), 1).otherwise(0)).alias("a"),
    )
    return histogram.groupBy("entity_type").agg(
        F.sum("b").alias("distinct_before"),
        F.sum("a").alias("distinct_after"),
        F.max(F.abs(F.col("b") - F.col("a"))).alias("max_abs_diff"),
    )


def leaks(df: DataFrame, id_col: str, out_col: str = "anonymized_text", spans_col: str = "spans") -> DataFrame:
    """Detected values that can still be read somewhere in the new text."""
    keys = F.transform(
        F.col(spans_col), lambda s: F.struct(s["entity_type"].alias("entity_type"), s["text"].alias("text"))
    )
    values = F.transform(counted(keys), lambda v: v["key"])
    left = F.filter(values, lambda v: F.contains(F.col(out_col), v["text"]))
    return (
        df.select(F.col(id_col), F.explode_outer(left).alias("_v"))
        .where(F.col("_v").isNotNull())
        .select(id_col, "_v.*")
    )


def leaks_across(df: DataFrame, id_col: str, out_col: str = "anonymized_text", spans_col: str = "spans") -> DataFrame:
    """``<id, entity_type, start, end, text>``: values detected in any document that can be read in a document's new text.

    The distinct values of the corpus are a phrase table: a small one is sent
    to the tasks, a large one goes through a Bloom filter of fixed size and a
    join. Values are found as whole words, in their own case; values without
    a letter or digit are not looked for.
    """
    keys = F.transform(F.col(spans_col), lambda s: F.struct(s["entity_type"].alias("entity_type"), s["text"].alias("phrase")))
    rows = df.select(F.explode_outer(F.transform(counted(keys), lambda v: v["key"])).alias("_v")).where(F.col("_v").isNotNull())
    table = PhraseTable(rows.select("_v.*"), name="detected values")
    hits = (hit_rows if table.small else joined_hits)(df, id_col, out_col, table)
    return hits.select(id_col, "entity_type", "start", "end", F.col("value").alias("text"))
