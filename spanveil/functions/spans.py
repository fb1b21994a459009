"""Span columns: find them, tidy them, cut texts by them.

Offsets are zero-based code points, start inclusive, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.arrays import bind, blocks, empty, groups, let, once, piece, positions, running

SPAN_TYPE = "struct<entity_type:string,start:int,end:int,score:double,explanation:string>"
ITEM_TYPE = "struct<operator:string,entity_type:string,start:int,end:int,text:string>"
MATCH_TYPE = "struct<start:int,end:int,value:string,before:string>"
ISLAND_TYPE = "struct<start:int,end:int,entity_type:string,score:double>"

# Word characters are spelled out: what \w and \b mean differs between
# Java releases and regex engines.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
WORD_START = rf"(?<!{WORD})"
WORD_END = rf"(?!{WORD})"
# How many words before a match can be its context.
CONTEXT_WORDS = 5


def after_boundary(first: str) -> str:
    """One ``first`` character at a word start.

    The character is consumed before looking behind, so that the matcher
    leaves most positions after a single class test.
    """
    return rf"{first}(?<!{WORD}{first})"


def last_words(text: str, count: int = CONTEXT_WORDS) -> str:
    """SQL: the end of ``text`` holding its last ``count`` words (or all of them)."""
    return f"reverse(regexp_extract(reverse({text}), r'^(?:{NOT_WORD}*{WORD}+){{1,{count}}}', 0))"


def words(text: str) -> str:
    """SQL: the words of a text."""
    return f"regexp_extract_all({text}, r'{WORD}+', 0)"


def pieces(text: str, regex: str) -> str:
    """SQL: matches and the text before each, as ``array<struct<value,gap>>``."""
    # there is one gap more than there are matches, but none before an empty match at the very start
    gaps = "if(size(_g) = size(_m), concat(array(''), _g), _g)"
    both = f"zip_with(_m, {gaps}, (_v, _w) -> named_struct('value', _v, 'gap', _w))"
    kept = f"filter({both}, _s -> _s.value IS NOT NULL)"
    return let(f"regexp_extract_all({text}, {regex}, 0)", "_m", let(f"split({text}, {regex}, -1)", "_g", kept))


def located(steps: str, body: str) -> str:
    """SQL: ``body`` for each match of :func:`pieces`.

    It sees the match as ``_s``, its position as ``_i``, and all ends as
    ``_ends``; the lengths of the pieces give the offsets.
    """
    ends = running("transform(_steps, _s -> length(_s.gap) + length(_s.value))")
    return let(steps, "_steps", let(ends, "_ends", f"transform(_steps, (_s, _i) -> {body})"))


def _context() -> str:
    """SQL: the last words before a match, from a few pieces back.

    Those hold enough words, unless matches hold none; only then the whole
    text before the match is looked at.
    """
    first = f"greatest(_i - {CONTEXT_WORDS}, 0)"
    near = (
        f"array_join(transform(sequence({first}, _i), _j -> "
        "concat(get(_steps, _j).gap, if(_j < _i, get(_steps, _j).value, ''))), '')"
    )
    enough = f"{first} = 0 OR size({words('_tail')}) >= {CONTEXT_WORDS}"
    whole = last_words("substring(v.text, 1, get(_ends, _i) - length(_s.value))")
    return let(last_words(near), "_tail", f"CASE WHEN {enough} THEN _tail ELSE {whole} END")


def matches(text: Column, regex: Column, words_before: Column | None = None) -> Column:
    """All matches of ``regex`` with offsets, as ``array<struct<start,end,value,before>>``.

    Where ``words_before`` is true, ``before`` ends just before the match and
    holds the words that can be its context.
    """
    fields = [text.alias("text"), regex.alias("regex")]
    before = "cast(NULL AS string)"
    if words_before is not None:
        fields.append(words_before.alias("wanted"))
        before = f"CASE WHEN v.wanted THEN {_context()} END"
    body = (
        "named_struct('start', get(_ends, _i) - length(_s.value), 'end', get(_ends, _i), "
        f"'value', _s.value, 'before', {before})"
    )
    found = located(pieces("v.text", "v.regex"), body)
    return bind(F.struct(*fields), f"filter({found}, _f -> _f.end > _f.start)")


def regex_matches(text: Column, regex: str) -> Column:
    """Matches of one expression; nothing is extracted unless there are any."""
    return F.when(text.rlike(regex), matches(text, F.lit(regex))).otherwise(empty(MATCH_TYPE))


def has_word(text: Column, wanted: Column) -> Column:
    """Whether one of ``wanted`` (lower case) is a whole word of ``text``, in any case."""
    return F.arrays_overlap(F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0)), wanted)


def first_of_each(candidates: Column, keys: list[str]) -> Column:
    """Sort an array of structs and keep the first one of every key."""
    same = " AND ".join(f"get(_c, _i - 1).{k} = _x.{k}" for k in keys)
    return bind(candidates, let("array_sort(v)", "_c", f"filter(_c, (_x, _i) -> _i = 0 OR NOT ({same}))"))


def merge_overlaps(spans: Column) -> Column:
    """Merge overlapping spans into islands, ordered by start.

    An island covers every span in it and takes the type of the best one by
    score, then length, then name. Spans that only touch stay apart.
    """
    ranked = (
        "array_sort(transform(v, _s -> named_struct('start', _s.start, 'end', _s.end, 'best', named_struct("
        "'score', cast(_s.score AS double), 'length', _s.end - _s.start, 'entity_type', _s.entity_type))))"
    )
    best = (
        f"aggregate({positions('_first + 1', '_last')}, get(_r, _first).best, "
        "(_a, _j) -> greatest(_a, get(_r, _j).best))"
    )
    island = let(
        best, "_top",
        "named_struct('start', get(_r, _first).start, 'end', get(_reach, _last), "
        "'entity_type', _top.entity_type, 'score', _top.score)",
    )
    apart = "_p = 0 OR get(_r, _p).start >= get(_reach, _p - 1)"
    reach = running("transform(_r, _s -> _s.end)", greatest=True)
    merged = let(ranked, "_r", let(reach, "_reach", groups("_r", apart, island)))
    return bind(spans, f"CASE WHEN size(v) > 0 THEN {merged} ELSE cast(array() AS array<{ISLAND_TYPE}>) END")


def inside(spans: Column, text: Column) -> Column:
    """Clip spans to the text and drop the empty ones."""
    clipped = (
        "transform(filter(v.spans, _s -> _s.start IS NOT NULL AND _s.end IS NOT NULL), _s -> named_struct('start', greatest(_s.start, 0), 'end', least(_s.end, v.n), "
        "'entity_type', _s.entity_type, 'score', _s.score))"
    )
    return bind(
        F.struct(spans.alias("spans"), F.length(text).alias("n")), f"filter({clipped}, _s -> _s.start < _s.end)"
    )


def surfaces(text: Column, spans: Column, fields: list[str]) -> Column:
    """Spans with the piece of text they cover as field ``text``."""
    kept = ", ".join(f"'{f}', _s.{f}" for f in fields)

    def cut(spans_sql: str, value: str) -> str:
        return f"transform({spans_sql}, _s -> named_struct({kept}, 'text', {value}))"

    full = bind(
        F.struct(blocks(text).alias("b"), spans.alias("spans")), cut("v.spans", piece("v.b", "_s.start", "_s.end"))
    )
    return F.when(F.size(spans) > 0, full).otherwise(bind(spans, cut("slice(v, 1, 0)", "''")))


def rewrite(text: Column, islands: Column, replace: Callable[[Column, Column], Column], more: tuple[str, ...] = ()) -> Column:
    """Replace every island of ``text``; gives ``struct<text, items>``.

    ``islands`` are ordered and do not overlap. ``replace(island, value)``
    gives ``struct<operator, text>``; it sees the island's fields named in
    ``more`` as well. Items carry offsets in the new text and
    come last first.
    """
    # name the value of each island, replace it, then put the text together
    values = (
        "named_struct('b', v.b, 'n', v.n, 'islands', transform(v.islands, _s -> "
        "named_struct('start', _s.start, 'end', _s.end, 'entity_type', _s.entity_type, "
        f"'value', {piece('v.b', '_s.start', '_s.end')}{''.join(f', {chr(39)}{f}{chr(39)}, _s.{f}' for f in more)})))"
    )
    given = F.struct(blocks(text).alias("b"), F.length(text).alias("n"), islands.alias("islands"))

    def replaced(v: Column) -> Column:
        done = F.transform(
            v["islands"], lambda s: F.struct(s.alias("s"), replace(s, s["value"]).alias("r"))
        )
        return F.struct(v["b"].alias("b"), v["n"].alias("n"), done.alias("done"))

    before = "if(_i = 0, 0, get(v.done, _i - 1).s.end)"
    kept = f"transform(v.done, (_d, _i) -> concat({piece('v.b', before, '_d.s.start')}, _d.r.text))"
    rest = piece("v.b", "element_at(v.done, -1).s.end", "v.n")
    growth = running("transform(v.done, _d -> length(_d.r.text) - (_d.s.end - _d.s.start))")
    items = (
        f"zip_with(v.done, {growth}, (_d, _w) -> named_struct('operator', _d.r.operator, "
        "'entity_type', _d.s.entity_type, 'start', _d.s.end + _w - length(_d.r.text), 'end', _d.s.end + _w, "
        "'text', _d.r.text))"
    )
    whole = f"named_struct('text', concat(array_join({kept}, ''), {rest}), 'items', reverse({items}))"
    named = bind(given, values)
    full = bind(once(named, replaced), whole)
    unchanged = F.struct(text.alias("text"), empty(ITEM_TYPE).alias("items"))
    return F.when(F.size(islands) > 0, full).otherwise(unchanged)
