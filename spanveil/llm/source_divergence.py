"""How far the sources of each language are from each other, and by which terms.

For each language a CountVectorizer with a least number of documents and no
limit of vocabulary makes exact sparse vectors of its documents; their sums
over sources (by batch in the tasks, then by Spark, in whole numbers) are
compared source by source. All arithmetic is on integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.common import sent_if_small, text_of
from spanveil.llm.tokens import released
from spanveil.plans.tables import fresh_path, stored

LEAST_DOCS = 10
ALL = 2**31 - 1  # the largest vocabulary there can be
SLICE_TERMS = 1_500_000  # distinct terms that one vectorizer sees, about; more are dealt over several
SCALE = 1_000_000_000
RANKS = 10
TERMS_PER_BLOCK = 4096
SOURCES_PER_TILE = 64
PAIRS_HELD = 1 << 20  # (source, term) sums that a task holds before it passes them on

# ------------------------------------------------------------------- terms

WINDOW = 1 << 20  # bytes that are cut into terms at once
PROBE = 12  # of the terms' hashes, one in 2 ** PROBE is kept to count distinct terms by

# Bytes of terms: a to z, A to Z as these, all bytes of characters beyond ASCII; 0 for all others.
_BYTES = np.zeros(256, np.uint8)
_BYTES[0x80:] = np.arange(0x80, 0x100)
_BYTES[ord("a") : ord("z") + 1] = _BYTES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2^64
_powers: list[np.ndarray] = []


def drop_powers() -> None:
    _powers.clear()


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, as long as the longest window so far."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (_BASE, inverse)]
    return _powers


def _hashes(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: polynomials by differences of one running sum, then mixed."""
    up, down = _power_tables(len(mapped))
    sums = np.cumsum((mapped.astype(np.uint64) + np.uint64(1)) * up[: len(mapped)])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    h = (sums[ends - 1] - before) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def cut(texts: pa.StringArray) -> tuple[pa.StringArray, pa.ListArray]:
    """The terms of each text with a space between them, and the hashes that are kept of them.

    A term is a run of letters, A to Z in lower case, and of any characters
    beyond ASCII. In UTF-8 these are whole runs of bytes, so terms are cut
    without making a string of any.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    parts, lengths, probes, probe_places = [], np.zeros(len(texts), np.int64), [], []
    at, stop, last_text = int(offsets[0]), int(offsets[-1]), -1
    while at < stop:
        to = min(stop, at + WINDOW)
        # a window ends at a text's end or where no term goes on, however long that one is
        while to < stop and _BYTES[data[to]]:
            more = np.flatnonzero(_BYTES[data[to : to + WINDOW]] == 0)
            to = min(stop, to + (int(more[0]) if len(more) else WINDOW))
        mapped = _BYTES[data[at:to]]
        inside = mapped != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        # texts follow each other without anything between
        borders = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        first[borders] |= inside[borders]
        starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        ends = np.flatnonzero(last) + 1
        # a space stands where a term of the same text is followed by another
        text = np.searchsorted(offsets, starts + at, "right") - 1
        more = np.r_[text[1:] == text[:-1], False] if len(text) else np.zeros(0, bool)
        kept = np.zeros(len(mapped) + 1, bool)
        kept[:-1] = inside
        kept[ends[more]] = True
        out = np.append(mapped, np.uint8(0))
        out[ends[more]] = ord(" ")
        lengths += np.bincount(text, ends - starts + more, len(texts)).astype(np.int64)
        if parts and len(text) and text[0] == last_text:
            parts.append(np.array([ord(" ")], np.uint8))
            lengths[last_text] += 1
        parts.append(out[kept])
        last_text = text[-1] if len(text) else last_text
        if len(starts):
            h = _hashes(mapped, starts, ends)
            few = h <= np.uint64((1 << (64 - PROBE)) - 1)
            probes.append(h[few].view(np.int64))
            probe_places.append(starts[few] + at)
        at = to
    ends = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    none = np.zeros(0, np.int64)
    spots = np.searchsorted(np.concatenate([none, *probe_places]), offsets).astype(np.int32)
    hashes = pa.ListArray.from_arrays(pa.array(spots), pa.array(np.concatenate([none, *probes]), pa.int64()))
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(values)), hashes


def _cutter(batches):
    for b in batches:
        body = b.column("body")
        terms, probe = cut(body if pa.types.is_string(body.type) else body.cast(pa.string()))
        yield pa.RecordBatch.from_arrays([b.column("lang_no"), b.column("group_no"), terms, probe], names=["lang_no", "group_no", "terms", "probe"])


# -------------------------------------------------------------------- sums


def _group_sums(batches):
    """Sparse vectors added up by source: rows (group, index, count)."""
    keys, sums, size = [], [], 0

    def passed():
        key = np.concatenate(keys)
        whole, spot = np.unique(key, return_inverse=True)
        total = np.zeros(len(whole), np.int64)
        np.add.at(total, spot, np.concatenate(sums))
        return whole, total

    def out(whole, total):
        for k in range(0, len(whole), 65_536):
            w = whole[k : k + 65_536]
            arrays = [pa.array((w >> 31).astype(np.int32)), pa.array((w & 0x7FFFFFFF).astype(np.int32)), pa.array(total[k : k + 65_536])]
            yield pa.RecordBatch.from_arrays(arrays, names=["group_no", "index", "count"])

    for b in batches:
        v = b.column("vector")
        at = v.field("indices")
        n = np.diff(at.offsets.to_numpy())
        index = at.flatten().to_numpy().astype(np.int64)
        count = v.field("values").flatten().to_numpy()
        key = (np.repeat(b.column("group_no").to_numpy().astype(np.int64), n) << 31) | index
        # counts in one document are whole and under 2^53
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        if not len(first):
            continue
        keys.append(key[first])
        sums.append(np.add.reduceat(count[order].astype(np.int64), first))
        size += len(first)
        if size > PAIRS_HELD:
            whole, total = passed()
            if len(whole) > PAIRS_HELD // 2:
                yield from out(whole, total)
                keys, sums, size = [], [], 0
            else:
                keys, sums, size = [whole], [total], len(whole)
    if keys:
        yield from out(*passed())


def _p(count: str) -> Column:
    """1 + floor(10^9 (count + 2) / (N + 2 V)), exact at any size."""
    return F.expr(f"1 + (CAST({SCALE} AS decimal(10,0)) * CAST({count} + 2 AS decimal(20,0))) DIV CAST(n_terms + 2 * n_kept AS decimal(20,0))")


def distance(p, q):
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so the square fits in 64 bits."""
    return (p - q) * (p - q) // (p + q)


def _distance_sql(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})"


PAIR_SUMS = "lang_no int, a int, b int, more long"


def _pair_sums(key, table):
    """What the terms of one block add to the distances of all pairs of two tiles of sources, beyond terms that are absent.

    Rows without a term name the sources that are there.
    """
    lang, _, a, b = (x.as_py() for x in key)
    tile, group, p, p0 = (table.column(c).to_numpy() for c in ("tile", "group_no", "p", "p0"))
    code = table.column("term").combine_chunks().dictionary_encode()
    n = len(code.dictionary)
    spot = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)

    def matrix(wanted: int):
        mine = tile == wanted
        groups, row = np.unique(group[mine], return_inverse=True)
        absent = np.zeros(len(groups), np.int64)
        absent[row] = p0[mine]
        out = np.repeat(absent[:, None], n, 1)
        known = spot[mine] >= 0
        out[row[known], spot[mine][known]] = p[mine][known]
        return groups, absent, out

    ga, na, ma = matrix(a)
    gb, nb, mb = matrix(b) if a != b else (ga, na, ma)
    ours, theirs, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(ga)):
        keep = np.flatnonzero(gb > ga[i]) if a == b else np.arange(len(gb))
        ours.append(np.full(len(keep), ga[i]))
        theirs.append(gb[keep])
        more.append(distance(ma[i], mb[keep]).sum(1) - distance(na[i], nb[keep]) * n)
    ours, theirs, more = map(np.concatenate, (ours, theirs, more))
    columns = {"lang_no": np.full(len(ours), lang, np.int32), "a": ours.astype(np.int32), "b": theirs.astype(np.int32), "more": more}
    return pa.table(columns)


def _sliced(tokens: DataFrame, slices: int) -> DataFrame:
    """The documents' terms dealt over slices of the vocabulary, still by document."""
    rows = tokens.withColumn("doc", F.monotonically_increasing_id()).select("doc", "group_no", F.explode("terms").alias("term"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int"))
    path = fresh_path(tokens.sparkSession, "sliced-terms")
    dealt = rows.groupBy("doc", "group_no", "slice").agg(F.collect_list("term").alias("terms"))
    dealt.select("slice", "group_no", "terms").write.partitionBy("slice").parquet(path)
    return tokens.sparkSession.read.schema("slice int, group_no int, terms array<string>").parquet(path)


def _counted(rows: DataFrame, lang_no: int, least_docs: int) -> DataFrame | None:
    """``lang_no, group_no, term, count`` of one vectorizer's vocabulary; None where it keeps no term."""
    spark = rows.sparkSession
    try:
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(least_docs), vocabSize=ALL).fit(rows)
    except IllegalArgumentException as e:
        if "vocabulary size" not in str(e):
            raise
        return None
    words = pa.array(model.vocabulary, pa.string())
    vocabulary = spark.createDataFrame(pa.table({"index": pa.array(np.arange(len(words), dtype=np.int32)), "term": words}))
    sums = model.transform(rows).select("group_no", "vector").mapInArrow(released(_group_sums, drop_powers), "group_no int, index int, count long")
    sums = sums.groupBy("group_no", "index").agg(F.sum("count").alias("count"))
    return stored(sums.join(vocabulary, "index").select(F.lit(lang_no).alias("lang_no"), "group_no", "term", "count"), "term-counts")


def term_counts(tokens: DataFrame, langs: DataFrame, least_docs: int = LEAST_DOCS, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """Occurrences of each kept term in each group, of a stored table ``lang_no, group_no, terms, probe`` made by :func:`cut`.

    One CountVectorizer for each language with enough documents; where a
    language has more distinct terms than ``slice_terms``, they are dealt by
    hash over several, so that the vocabulary in the driver and in a broadcast
    stays bounded. A term and its documents are always in one of them.
    """
    spark = tokens.sparkSession
    wanted = [r["lang_no"] for r in langs.where(F.col("n_docs") >= least_docs).select("lang_no").orderBy("lang_no").toLocalIterator()]
    each = tokens.select("lang_no", F.explode("probe").alias("hash")).groupBy("lang_no").agg(F.count_distinct("hash").alias("n"))
    # of all distinct terms those whose hashes are small; none seen means few
    sizes = {r["lang_no"]: max(1, r["n"] << PROBE) for r in each.toLocalIterator()}
    out = spark.createDataFrame([], "lang_no int, group_no int, term string, count long")
    for lang_no in wanted:
        listed = F.when(F.col("terms") == "", F.array().cast("array<string>")).otherwise(F.split("terms", " "))
        mine = tokens.where(F.col("lang_no") == lang_no).select("group_no", listed.alias("terms"))
        slices = -(-sizes.get(lang_no, 1) // slice_terms)
        parts = [mine] if slices == 1 else [_sliced(mine, slices)]
        if slices > 1:
            parts = [parts[0].where(F.col("slice") == k) for k in range(slices)]
        for part in parts:
            counted = _counted(part, lang_no, least_docs)
            out = out if counted is None else out.unionByName(counted)
    return out


def source_divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_docs: int = LEAST_DOCS, ranks: int = RANKS, slice_terms: int = SLICE_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for each group of a language and a source.

    Part ``pair``: every other source of the language by distance, farthest
    first. Part ``term``: the ``ranks`` terms that set the group most apart
    from its language, of those that are more frequent in it.

    A language keeps the terms in ``least_docs`` of its documents or more.
    NULL texts, languages and sources are empty strings. Repeated rows count
    each. A language without kept terms has pairs at distance 0; ties go by
    item, in the order of bytes. An empty table gives no rows. Columns are
    read by name, others are not read.

    Texts are cut into terms once, into a stored table dealt by language. The
    sums of a group never meet in one task: documents are added up where they
    are, then by (group, term); pairs of sources are worked out by blocks of
    terms and tiles of sources. The result has all pairs of a language's
    sources, as asked for.
    """
    spark = docs.sparkSession
    base = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("body"))
    found = stored(base.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs")), "groups")
    lang_table = found.groupBy("lang").agg(F.sum("n_docs").alias("n_docs")).withColumn("lang_no", F.row_number().over(Window.orderBy("lang")))
    langs = stored(lang_table, "languages")
    numbered = found.drop("n_docs").join(sent_if_small(langs.drop("n_docs")), "lang")
    groups = stored(numbered.withColumn("group_no", F.row_number().over(Window.partitionBy("lang_no").orderBy("source")) - 1), "numbered-groups")

    path = fresh_path(spark, "terms")
    placed = base.join(sent_if_small(groups), ["lang", "source"]).select("lang_no", "group_no", "body")
    kind = "lang_no int, group_no int, terms string, probe array<long>"
    # every document stays, with or without terms
    placed.mapInArrow(released(_cutter, drop_powers), kind).write.partitionBy("lang_no").option("compression", "lz4").parquet(path)
    tokens = spark.read.schema(kind).parquet(path)
    counts = stored(term_counts(tokens, langs, least_docs, slice_terms), "all-term-counts")

    own = counts.groupBy("lang_no", "group_no").agg(F.sum("count").alias("n_terms"))
    every = counts.groupBy("lang_no", "term").agg(F.sum("count").alias("total")).groupBy("lang_no")
    whole = stored(every.agg(F.count(F.lit(1)).alias("n_kept"), F.sum("total").alias("lang_terms")), "vocabularies")
    sized = groups.join(own, ["lang_no", "group_no"], "left").join(whole, "lang_no", "left").na.fill(0, ["n_terms", "n_kept", "lang_terms"])
    p0 = F.when(F.col("n_kept") > 0, _p("0")).otherwise(F.lit(0).cast("long"))
    sized = stored(sized.withColumn("p0", p0).withColumn("tile", F.floor(F.col("group_no") / F.lit(SOURCES_PER_TILE)).cast("int")), "sized-groups")

    # a term's total in its language stands beside each of its rows: a term has as many rows as there are sources
    with_total = counts.withColumn("total", F.sum("count").over(Window.partitionBy("lang_no", "term")))
    known = with_total.join(sent_if_small(sized), ["lang_no", "group_no"]).withColumn("p", _p("count"))
    lang_p = F.expr(f"1 + (CAST({SCALE} AS decimal(10,0)) * CAST(total + 2 AS decimal(20,0))) DIV CAST(lang_terms + 2 * n_kept AS decimal(20,0))")
    apart = known.withColumn("q", lang_p).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_distance_sql("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = apart.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)

    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("n_kept") / F.lit(TERMS_PER_BLOCK))).cast("int")
    rows = known.select("lang_no", block.alias("block"), "tile", "group_no", "term", "p", "p0")
    blocks = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n_kept") / F.lit(TERMS_PER_BLOCK)) - 1).cast("int"))).alias("block")
    there = sized.where("n_kept > 0").select("lang_no", blocks, "tile", "group_no", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), "p0")
    tiles = sized.groupBy("lang_no").agg((F.max("tile") + 1).alias("tiles"))
    dealt = rows.unionByName(there).join(sent_if_small(tiles), "lang_no")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})
    sums = dealt.groupBy("lang_no", "block", "a", "b").applyInArrow(_pair_sums, PAIR_SUMS)
    sums = sums.groupBy("lang_no", "a", "b").agg(F.sum("more").alias("more"))

    ends = sized.select("lang_no", "lang", "source", "group_no", "n_kept", "p0")
    left, right = (ends.select("lang_no", *[F.col(c).alias(f"{c}_{x}") for c in ends.columns[1:]]) for x in "ab")
    pairs = left.join(right, "lang_no").where("group_no_a <> group_no_b")
    pairs = pairs.withColumns({"a": F.least("group_no_a", "group_no_b"), "b": F.greatest("group_no_a", "group_no_b")})
    absent = F.when(F.col("n_kept_a") > 0, F.col("n_kept_a") * F.expr(_distance_sql("p0_a", "p0_b"))).otherwise(F.lit(0))
    pairs = pairs.join(sums, ["lang_no", "a", "b"], "left").select(
        F.col("lang_a").alias("lang"), F.col("source_a").alias("source"), F.col("source_b").alias("item"),
        (absent + F.coalesce("more", F.lit(0))).cast("long").alias("value"),
    )
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(pairs, "pair").unionByName(shape(terms, "term"))
