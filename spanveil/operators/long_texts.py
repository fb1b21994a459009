"""Very long documents, detected in parallel.

A long text is cut into chunks; each is searched together with a halo of text
on both sides, in a task of its own. A span belongs to the chunk in which it
starts.

Whether that gives what the whole text would give can be seen from the hits
themselves. A pattern's hits follow each other without overlap, so what is
found depends on where the search began; but a stretch without hits that is
longer than any hit of the pattern brings both searches together. Documents
in which some halo has no such stretch, or too few words for the context, are
searched whole.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.arrays import bind
from spanveil.functions.spans import CONTEXT_WORDS, WORD
from spanveil.operators.analyze import analyze
from spanveil.operators.recognizers import registry
from spanveil.plans.options import AnalyzeOptions, EngineOptions
from spanveil.plans.tables import stored

CHUNK = 1 << 18  # code points
HALO = 1 << 12


def windows(df: DataFrame, id_col: str, text_col: str, *keep: str, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """``<id, chunk_no, before, own, text>``: each chunk with its halo.

    ``text`` begins ``before`` code points ahead of the chunk, which has
    ``own`` code points. An empty text has one empty chunk.
    """
    if not 0 < halo <= chunk:
        raise ValueError("the halo must be shorter than a chunk")
    cut = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{chunk}}}+"), F.lit(0))
    cut = F.when(F.col(text_col) == "", F.array(F.lit(""))).otherwise(cut)
    window = (
        f"transform(v, (_x, _i) -> named_struct('chunk_no', _i, 'before', if(_i = 0, 0, {halo}), 'own', length(_x), "
        f"'text', concat(coalesce(right(get(v, _i - 1), {halo}), ''), _x, coalesce(left(get(v, _i + 1), {halo}), ''))))"
    )
    return df.select(id_col, *keep, F.explode(bind(cut, window)).alias("_w")).select(id_col, *keep, "_w.*")


def _dealt(cut: DataFrame, id_col: str) -> DataFrame:
    """Chunks dealt over tasks, whatever their bytes: it is the search that takes time."""
    count = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(count, id_col, "chunk_no")


def _uncertain(searched: DataFrame, id_col: str, halo: int) -> DataFrame:
    """Ids of documents whose chunks may differ from a search of the whole text."""
    few = F.col("before").cast("boolean") & (F.col("words_before") < CONTEXT_WORDS + 2)
    hits = searched.select(id_col, "chunk_no", "before", F.explode("hits").alias("_h"))
    of_window = hits.groupBy(id_col, "chunk_no", "before", "_h.recognizer", "_h.pattern").agg(
        F.max(F.col("_h.end") - F.col("_h.start")).alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("_h.start") < F.col("before"), F.struct("_h.start", "_h.end")))).alias("early"),
    )
    stretch = F.expr(
        "aggregate(early, named_struct('last', 0, 'gap', 0), (_a, _x) -> named_struct('last', greatest(_a.last, _x.end), "
        "'gap', greatest(_a.gap, _x.start - _a.last)), _a -> greatest(_a.gap, before - _a.last))"
    )
    # a chunk without early hits has the whole halo as a stretch
    gap = F.when((F.col("before") > 0) & (F.size("early") > 0), stretch).otherwise(F.lit(halo))
    of_doc = of_window.groupBy(id_col, "recognizer", "pattern").agg(F.max("longest").alias("longest"), F.min(gap).alias("gap"))
    unsettled = of_doc.where(F.col("longest") >= F.least("gap", F.lit(halo // 2)))
    return searched.where(few).select(id_col).union(unsettled.select(id_col)).distinct()


def analyze_long(
    df: DataFrame,
    id_col: str,
    options: AnalyzeOptions | None = None,
    engine: EngineOptions | None = None,
    text_col: str = "text",
    lang_col: str | None = None,
    with_text: bool = False,
    chunk: int = CHUNK,
    halo: int = HALO,
) -> DataFrame:
    """``<id, spans, status>`` like :func:`analyze`, texts longer than two chunks in parallel.

    Shorter texts stay where they are. Only chunks are shuffled, dealt over
    the tasks; spans come back by document. ``id_col`` must be unique. The
    result equals that of the whole text unless an expression looks further
    ahead or back than ``halo`` code points, or asks for the end or the
    beginning of the text from within.
    """
    engine, options = engine or EngineOptions(), options or AnalyzeOptions()
    if engine.log_decision_process:
        raise ValueError("decisions on chunks are not stitched; use analyze")
    if isinstance(options.entities, Column) or isinstance(options.score_threshold, Column):
        raise ValueError("chunks have no columns of their document; entities and threshold must be values")
    wanted = options.entities
    chosen = registry(engine.registry(), options.ad_hoc_recognizers)
    if isinstance(wanted, tuple | list):
        upper = {e.upper() for e in wanted}
        chosen = [r for r in chosen if r.entity_type.upper() in upper]
    keep = [c for c in {lang_col} if c]
    rows = df.select(id_col, text_col, *keep)
    long = F.length(text_col) > 2 * chunk
    out = ["spans", "status"]

    def whole(part: DataFrame) -> DataFrame:
        return analyze(part, options, engine, text_col, lang_col, with_text=with_text, id_col=id_col).select(id_col, *out)

    short = whole(rows.where(~F.coalesce(long, F.lit(False))))
    cut = _dealt(windows(rows.where(long), id_col, text_col, *keep, chunk=chunk, halo=halo), id_col)
    traced = replace(engine, recognizers=tuple(chosen), regex=(), deny_list=(), log_decision_process=True)
    found = analyze(cut, replace(options, ad_hoc_recognizers=()), traced, "text", lang_col, with_text=with_text)
    names = [f.name for f in found.schema["spans"].dataType.elementType.fields if f.name not in ("start", "end")]
    base = f"(v.chunk_no * {chunk} - v.before)"
    moved = ", ".join([f"'{n}', _s.{n}" for n in names[:1]] + [f"'start', _s.start + {base}", f"'end', _s.end + {base}"] + [f"'{n}', _s.{n}" for n in names[1:]])
    own = bind(
        F.struct("spans", "chunk_no", "before", "own"),
        f"transform(filter(v.spans, _s -> _s.start >= v.before AND _s.start < v.before + v.own), _s -> named_struct({moved}))",
    )
    hits = F.transform("decisions", lambda d: F.struct(*[d[c].alias(c) for c in ("recognizer", "pattern", "start", "end")]))
    words = F.size(F.regexp_extract_all(F.left("text", "before"), F.lit(f"{WORD}+"), F.lit(0)))
    searched = stored(
        found.select(id_col, "chunk_no", "before", own.alias("spans"), hits.alias("hits"), words.alias("words_before"), "status"), "chunks"
    )
    again = stored(_uncertain(searched, id_col, halo), "uncertain-documents")
    settled = searched.join(again, id_col, "left_anti").groupBy(id_col).agg(
        F.collect_list(F.struct("chunk_no", "spans")).alias("_c"), F.first("status").alias("status")
    )
    kind = found.schema["spans"].dataType.simpleString()
    # the spans of a chunk are in order, and chunks follow each other
    stitched = F.flatten(F.transform(F.array_sort("_c"), lambda c: c["spans"])).cast(kind)
    rest = whole(rows.where(long).join(again, id_col, "left_semi"))
    return short.unionByName(settled.select(id_col, stitched.alias("spans"), "status")).unionByName(rest)
