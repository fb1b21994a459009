"""Analyze: documents to spans, without a shuffle."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanveil.functions.arrays import bind, empty, let, literal
from spanveil.functions.spans import SPAN_TYPE, first_of_each, has_word, matches
from spanveil.operators.phrases import PhraseTable, add_hits, free_name, joined_hits, phrase_candidates
from spanveil.operators.recognizers import (
    Pattern,
    Recognizer,
    prune,
    registry,
)
from spanveil.plans.options import AnalyzeOptions, EngineOptions

KEY = ["start", "end", "entity_type"]
# The order of the fields is the order of preference within one place.
CANDIDATE_TYPE = (
    "struct<start:int,end:int,entity_type:string,minus_score:double,recognizer:string,pattern:string,"
    "base_score:double,value:string>"
)
# With the outcome of the check on the value, where failures are kept.
TRACED_TYPE = CANDIDATE_TYPE[:-1] + ",passed:boolean>"
DECISION_TYPE = (
    "struct<recognizer:string,pattern:string,entity_type:string,start:int,end:int,base_score:double,"
    "final_score:double,kept:boolean,reason:string>"
)
TABLE_TYPE = (
    "array<struct<entity_type:string,recognizer:string,pattern:string,regex:string,base:double,lifted:double,"
    "context:array<string>,check:int>>"
)


def candidates(
    text: Column,
    recognizers: Iterable[Recognizer],
    entities: Iterable[str] | None = None,
    threshold: float = 0.0,
    language: Column | None = None,
    traced: bool = False,
) -> Column:
    """Every match of every pattern that can still count; if ``traced``, also those whose value fails its check.

    Each pattern tests the text once, with a literal expression. Only those
    that hit go through the extraction, which is one shared expression over
    the pattern's row in a constant table; the plan stays small however many
    recognizers there are.
    """
    chosen = prune(recognizers, entities, threshold)
    kind = TRACED_TYPE if traced else CANDIDATE_TYPE
    if not chosen:
        return empty(kind)
    checks = list({id(r.check): r.check for r, _ in chosen if r.check is not None}.values())
    with_context = any(r.context for r, _ in chosen)

    guards = sorted({g for _, p in chosen for g in p.guards})

    def guard(g: str) -> str:
        return f"v.text RLIKE {literal(g)}" if g.startswith("[") else f"contains(v.text, {literal(g)})"

    def hit(r: Recognizer, p: Pattern) -> str:
        tests = [f"_g.g{guards.index(g)}" for g in p.guards]
        if r.languages is not None and language is not None:
            tests.append(f"v.lang IN ({', '.join(literal(x) for x in r.languages)})")
        return " AND ".join([*tests, f"v.text RLIKE {literal(p.regex)}"])

    def row(r: Recognizer, p: Pattern) -> dict:
        return {
            "entity_type": r.entity_type,
            "recognizer": r.name,
            "pattern": p.name,
            "regex": p.regex,
            "base": p.score,
            "lifted": r.best_score(p),
            "context": [w for term in r.context for w in re.findall(r"\w+", term.lower())],
            "check": next((i for i, c in enumerate(checks) if c is r.check), -1),
        }

    table = F.from_json(F.lit(json.dumps([row(r, p) for r, p in chosen])), TABLE_TYPE)

    def extract(p: Column) -> Column:
        contextual = F.size(p["context"]) > 0 if with_context else None
        found = matches(text, p["regex"], contextual)

        def passes(m: Column) -> Column:
            if not checks:
                return F.lit(True)
            verdict = F.when(p["check"] == 0, checks[0](m["value"]))
            for i, check in enumerate(checks[1:], 1):
                verdict = verdict.when(p["check"] == i, check(m["value"]))
            return verdict.otherwise(True)

        if checks and not traced:
            found = F.filter(found, passes)

        def candidate(m: Column) -> Column:
            score = p["base"]
            if with_context:
                score = F.when(has_word(m["before"], p["context"]), p["lifted"]).otherwise(p["base"])
            return F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                p["entity_type"].alias("entity_type"),
                (-score).alias("minus_score"),
                p["recognizer"].alias("recognizer"),
                p["pattern"].alias("pattern"),
                p["base"].alias("base_score"),
                m["value"].alias("value"),
                *([F.coalesce(passes(m), F.lit(False)).alias("passed")] if traced else []),
            )

        return F.transform(found, candidate)

    # every distinct guard is evaluated once per text
    guarded = ", ".join(f"'g{i}', {guard(g)}" for i, g in enumerate(guards)) or "'none', true"
    hits = bind(
        F.struct(text.alias("text"), (F.lit("") if language is None else language).alias("lang")),
        let(f"named_struct({guarded})", "_g", f"array({', '.join(hit(r, p) for r, p in chosen)})"),
    )
    parts = F.zip_with(table, hits, lambda p, h: F.when(h, extract(p)).otherwise(empty(kind)))
    return F.flatten(parts)


# SQL: one line on how a span was found; v.q is a single quote
EXPLANATION = """replace(concat('recognizer ', v.q, _c.recognizer, v.q, ', pattern ', v.q, _c.pattern, v.q, ', score ',
  format_number(_c.base_score, 2), if(-_c.minus_score > _c.base_score,
  concat(', raised to ', format_number(-_c.minus_score, 2), ' by context'), '')), '"', v.q)"""


def _plan(engine: EngineOptions, options: AnalyzeOptions):
    own = options.score_threshold
    if isinstance(own, Column):
        limit, static = F.when(own > 0, own).otherwise(F.lit(engine.default_score_threshold)), 0.0
    else:
        static = own if own > 0 else engine.default_score_threshold
        limit = F.lit(static)
    wanted = options.entities
    chosen = registry(engine.registry(), options.ad_hoc_recognizers)
    if wanted is not None and not isinstance(wanted, Column):
        known = {r.entity_type.upper() for r in chosen}
        unknown = {e.upper() for e in wanted} - known
        if unknown and engine.phrase_tables:
            unknown -= {t.upper() for table in engine.phrase_tables for t in table.size["types"]}
        if unknown:
            raise ValueError(f"no recognizer for {sorted(unknown)}")
    return chosen, limit, static, wanted


_COMPILED: set[str] = set()


def check_expressions(spark, recognizers: Iterable[Recognizer]) -> None:
    """Try every expression in the session's Java, so that a bad one fails before the job starts."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return  # a remote session: the expression fails in the job
    for r in recognizers:
        for p in r.patterns:
            if p.regex in _COMPILED:
                continue
            try:
                jvm.java.util.regex.Pattern.compile(p.regex)
            except Exception as e:
                reason = str(getattr(e, "java_exception", e)).splitlines()[0]
                raise ValueError(f"pattern {p.name!r} of {r.name!r} is no Java expression: {reason}") from None
            _COMPILED.add(p.regex)


def _spoken(recognizers: Iterable, language: str) -> list:
    return [r for r in recognizers if r.languages is None or language in r.languages]


def _with_phrases(
    df: DataFrame, found: Column, tables: Iterable[PhraseTable], text_col: str, id_col: str | None, language: Column, traced: bool
) -> tuple[DataFrame, Column, list[str]]:
    """Candidates from phrase tables beside those of patterns; the columns that were added on the way."""
    kind, added = TRACED_TYPE if traced else CANDIDATE_TYPE, []
    for k, table in enumerate(tables):
        name = free_name(df, f"_phrases{k}")
        added.append(name)
        if table.small:
            df = add_hits(df, F.col(text_col), table, name)
            more = phrase_candidates(F.col(name), table, CANDIDATE_TYPE)
        else:
            if id_col is None or df.isStreaming:
                raise ValueError(
                    f"phrase table {table.name!r} is too large to be sent to every task: analyze needs the documents' unique id_col "
                    "to join it, and a stream cannot"
                )
            rows = joined_hits(df, id_col, text_col, table)
            hits = rows.groupBy(id_col).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != id_col])).alias("_h"))
            listed = hits.select(id_col, phrase_candidates(F.col("_h"), table, CANDIDATE_TYPE).alias(name))
            df, more = df.join(listed, id_col, "left"), F.coalesce(F.col(name), empty(CANDIDATE_TYPE))
        if traced:
            more = F.transform(more, lambda c: F.struct(*[c[f].alias(f) for f in _fields(CANDIDATE_TYPE)], F.lit(True).alias("passed")))
        if table.languages is not None:
            more = F.when(language.isin(*table.languages), more).otherwise(empty(kind))
        found = F.concat(found, more)
    return df, found, added


def _fields(kind: str) -> list[str]:
    return [f.split(":")[0] for f in kind[len("struct<") : -1].split(",")]


def _decisions(found: Column, limit: Column, wanted) -> Column:
    """All candidates with what became of them; kept ones in order, one per place and type, come first."""
    given = [F.array_sort(found).alias("found"), limit.alias("least")]
    named = "true"
    if isinstance(wanted, Column):
        given.append(wanted.alias("wanted"))
        named = "(v.wanted IS NULL OR array_contains(v.wanted, _c.entity_type))"
    elif wanted is not None:
        named = f"upper(_c.entity_type) IN ({', '.join(literal(w.upper()) for w in wanted)})"
    reason = f"CASE WHEN NOT _c.passed THEN 'check' WHEN NOT {named} THEN 'entity_type' WHEN -_c.minus_score < v.least THEN 'score' END"
    again = " AND ".join(f"get(_good, _i - 1).{k} = _c.{k}" for k in KEY)

    def row(why: str) -> str:
        fields = {
            "recognizer": "_c.recognizer", "pattern": "_c.pattern", "entity_type": "_c.entity_type", "start": "_c.start", "end": "_c.end",
            "base_score": "_c.base_score", "final_score": "-_c.minus_score", "kept": f"({why}) IS NULL", "reason": why, "value": "_c.value",
        }
        return f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {x}' for k, x in fields.items())})"

    good = let(
        f"filter(v.found, _c -> ({reason}) IS NULL)", "_good",
        f"transform(_good, (_c, _i) -> {row(f'CASE WHEN _i > 0 AND {again} THEN {chr(39)}better candidate{chr(39)} END')})",
    )
    bad = f"transform(filter(v.found, _c -> ({reason}) IS NOT NULL), _c -> {row(reason)})"
    return bind(F.struct(*given), f"concat({good}, {bad})")


def analyze(
    df: DataFrame,
    options: AnalyzeOptions | None = None,
    engine: EngineOptions | None = None,
    text_col: str = "text",
    lang_col: str | None = None,
    spans_col: str = "spans",
    with_text: bool = False,
    id_col: str | None = None,
    decisions_col: str = "decisions",
) -> DataFrame:
    """Add the spans found in ``text_col``, and a ``status`` per document.

    The language is the option's, or each document's own if ``lang_col`` is
    given. With ``with_text`` every span also carries the text it covers.
    Phrase tables that are too large to be sent to every task are joined by
    ``id_col``, which must be unique.

    If ``engine.log_decision_process`` is set, ``decisions_col`` holds every
    candidate of the same pass and what became of it (:func:`decision_log`
    has the reasons); nothing is pruned then.
    """
    engine, options = engine or EngineOptions(), options or AnalyzeOptions()
    chosen, limit, static, wanted = _plan(engine, options)
    check_expressions(df.sparkSession, chosen)
    tables = list(engine.phrase_tables)
    text = F.col(text_col)
    language = F.lower(F.col(lang_col)) if lang_col else F.lit(options.language)
    per_row, traced = isinstance(wanted, Column), engine.log_decision_process
    if not lang_col:
        chosen, tables = _spoken(chosen, options.language), _spoken(tables, options.language)
    if not traced:
        tables = [t.wanted(None if per_row else wanted) for t in tables if t.best_score >= static]
    found = candidates(
        text, chosen, None if per_row or traced else wanted, 0.0 if traced else static, language if lang_col else None, traced
    )
    df, found, added = _with_phrases(df, found, tables, text_col, id_col, language, traced)

    keep = "-_c.minus_score >= v.least"
    explanation = EXPLANATION if options.return_decision_process else "cast(NULL AS string)"
    fields = (
        "'entity_type', _c.entity_type, 'start', _c.start, 'end', _c.end, 'score', -_c.minus_score, "
        f"'explanation', {explanation}" + (", 'text', _c.value" if with_text else "")
    )
    supported = F.lit(True)
    if engine.supported_languages is not None:
        supported = F.coalesce(language.isin(*engine.supported_languages), F.lit(False))
    status = (
        F.when(text.isNull(), "missing_text")
        .when(~supported, "unsupported_language")
        .otherwise("ok")
    )
    ready = text.isNotNull() & supported
    if traced:
        made = F.when(ready, _decisions(found, limit, wanted)).otherwise(empty(DECISION_TYPE[:-1] + ",value:string>"))
        df = df.withColumn(decisions_col, made)
        kept = bind(
            F.struct(F.col(decisions_col).alias("found"), F.lit("'").alias("q")),
            f"transform(filter(v.found, _c -> _c.kept), _c -> {fields_of_decision(fields)})",
        )
        return df.withColumns({spans_col: kept, "status": status}).drop(*added)

    given = [first_of_each(found, KEY).alias("found"), limit.alias("least"), F.lit("'").alias("q")]
    if per_row:
        given.append(wanted.alias("wanted"))
        keep += " AND (v.wanted IS NULL OR array_contains(v.wanted, _c.entity_type))"
    spans = bind(F.struct(*given), f"transform(filter(v.found, _c -> {keep}), _c -> named_struct({fields}))")
    nothing = empty(SPAN_TYPE[:-1] + ",text:string>" if with_text else SPAN_TYPE)
    return df.withColumns({spans_col: F.when(ready, spans).otherwise(nothing), "status": status}).drop(*added)


def fields_of_decision(fields: str) -> str:
    """SQL: a span from a decision, which has its score under another name."""
    return f"named_struct({fields.replace('-_c.minus_score', '_c.final_score')})"


def filter_entities(spans: Column, entities: Iterable[str]) -> Column:
    """Keep spans of some types; for spans that came from outside."""
    return F.filter(spans, lambda s: s["entity_type"].isin(*entities))


def filter_scores(spans: Column, threshold: float) -> Column:
    """Keep spans whose score is at least ``threshold``."""
    return F.filter(spans, lambda s: s["score"] >= threshold)


def combine_spans(*spans: Column, fields: Iterable[str] = ("explanation",)) -> Column:
    """Spans of several origins together; the best score per place and type stays.

    ``fields`` are carried along: all spans need them (``text``, say, where
    they were found with it).
    """
    fields = list(fields)
    ranked = F.transform(
        F.concat(*spans),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["entity_type"].alias("entity_type"),
            (-s["score"]).alias("minus_score"),
            *[s[f].alias(f) for f in fields],
        ),
    )
    return F.transform(
        first_of_each(ranked, KEY),
        lambda s: F.struct(
            s["entity_type"].alias("entity_type"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            (-s["minus_score"]).alias("score"),
            *[s[f].alias(f) for f in fields],
        ),
    )


def span_rows(df: DataFrame, *keep: str, spans_col: str = "spans") -> DataFrame:
    """One row per span.

    The outer form plus a test afterwards: a plain explode makes Spark infer a
    filter on the array, and pushing that down would detect everything twice.
    """
    rows = df.select(*keep, F.explode_outer(spans_col).alias("_s")).where(F.col("_s").isNotNull())
    return rows.select(*keep, "_s.*")


def decision_log(
    df: DataFrame,
    id_col: str,
    options: AnalyzeOptions | None = None,
    engine: EngineOptions | None = None,
    text_col: str = "text",
    lang_col: str | None = None,
    decisions_col: str = "decisions",
) -> DataFrame:
    """One row per candidate: its scores, whether it was kept, and if not, why.

    Reasons: ``check`` (the value failed its check), ``entity_type`` (not
    asked for), ``score`` (under the threshold), ``better candidate`` (the
    same place and type were found with a better score). Patterns that cannot
    reach the threshold are in the log as well.

    Documents that :func:`analyze` has given their decisions are not searched
    again.
    """
    options = options or AnalyzeOptions()
    if decisions_col not in df.columns:
        traced = replace(engine or EngineOptions(), log_decision_process=True)
        df = analyze(df, options, traced, text_col, lang_col, id_col=id_col, decisions_col=decisions_col)
    rows = span_rows(df, id_col, spans_col=decisions_col).drop("value")
    return rows.select(F.lit(options.correlation_id).cast("string").alias("correlation_id"), "*")


REASONS = ("check", "entity_type", "score", "better candidate")


def observe_decisions(df: DataFrame, observation: Observation, decisions_col: str = "decisions") -> DataFrame:
    """Count decisions while the documents are written: ``kept``, and each reason with underscores.

    The counts are there (``observation.get``) once an action has run; no
    second pass is made.
    """
    def count(test) -> Column:
        return F.coalesce(F.sum(F.size(F.filter(decisions_col, test))), F.lit(0))

    def named(reason: str):
        return lambda d: d["reason"] == reason

    counts = [count(lambda d: d["kept"]).alias("kept"), *[count(named(r)).alias(r.replace(" ", "_")) for r in REASONS]]
    return df.observe(observation, *counts)
