"""Helpers over array columns that stay near linear in the array length.

A fold that appends to an array copies all of it at every step, so nothing
here collects results in an accumulator: values are looked up by position.

Bodies of several steps are SQL text. One expression then takes one parse,
where building it call by call takes thousands of round trips to the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points per block when a text is cut up for slicing.
BLOCK = 4096
# Elements per block of a running total are 2 ** SHIFT.
SHIFT = 5
NO_INTS = "cast(array() AS array<int>)"


def empty(element_type: str) -> Column:
    return F.expr(f"cast(array() as array<{element_type}>)")


def literal(text: str) -> str:
    """SQL: a string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """SQL: evaluate ``value`` once and use it as ``name`` in ``body``.

    A fold over nothing: its start is the value, its finish the body. Unlike
    a one-element transform it does not copy the value.
    """
    return f"aggregate({NO_INTS}, {value}, ({name}, _e) -> {name}, {name} -> {body})"


def bind(value: Column, body: str) -> Column:
    """A SQL expression over one value, named ``v`` in it."""
    return F.call_function("aggregate", empty("int"), value, F.expr("(v, _e) -> v"), F.expr(f"v -> {body}"))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """Like :func:`bind`, for a body that needs functions of columns."""
    return F.aggregate(empty("int"), value, lambda v, _: v, body)


def positions(first: str, last: str) -> str:
    """SQL: ``first`` to ``last`` inclusive; empty when there is none."""
    return f"(CASE WHEN {last} >= {first} THEN sequence({first}, {last}) ELSE {NO_INTS} END)"


def totals(values: str, body: Callable[[Callable[[str], str]], str], greatest: bool = False, levels: int = 1) -> str:
    """SQL: look up running sums of an integer array (or running maxima from 0).

    ``body`` is given a function from a position to the total up to it. Totals
    of whole blocks are kept, so that each lookup goes over one block only.
    """
    v, before = f"_v{levels}", f"_b{levels}"

    def combine(a: str, b: str) -> str:
        return f"greatest({a}, {b})" if greatest else f"{a} + {b}"

    def over(first: str, last: str) -> str:
        return f"aggregate({positions(first, last)}, 0, (_a, _j) -> cast({combine('_a', f'get({v}, _j)')} AS int))"

    if levels == 0:
        return let(values, v, body(lambda i: over("0", i)))
    last = f"(size({v}) - 1)"
    sums = (
        f"transform({positions('0', f'shiftright({last}, {SHIFT})')}, _k -> "
        f"{over(f'shiftleft(_k, {SHIFT})', f'least(shiftleft(_k + 1, {SHIFT}) - 1, {last})')})"
    )
    kept = f"CASE WHEN size({v}) <= {1 << SHIFT} THEN {NO_INTS} ELSE {running(sums, greatest, levels - 1)} END"

    def at(i: str) -> str:
        block = f"shiftright({i}, {SHIFT})"
        earlier = f"coalesce(get({before}, {block} - 1), 0)"
        return f"cast({combine(earlier, over(f'shiftleft({block}, {SHIFT})', i))} AS int)"

    return let(values, v, let(kept, before, body(at)))


def running(values: str, greatest: bool = False, levels: int = 1) -> str:
    """SQL: the running sum of an integer array, or its running maximum from 0."""
    array = f"_v{levels}"
    return totals(values, lambda at: f"transform({array}, (_x, _i) -> {at('_i')})", greatest, levels)


def groups(array: str, begins: str, body: str) -> str:
    """SQL: one ``body`` per group of neighbours in ``array``.

    ``begins`` tells for position ``_p`` whether a group begins there;
    ``body`` sees the group's ``_first`` and ``_last`` position.
    """
    starts = f"filter({positions('0', f'size({array}) - 1')}, _p -> {begins})"
    ends = f"transform(_starts, (_x, _i) -> coalesce(get(_starts, _i + 1), size({array})) - 1)"
    return let(starts, "_starts", f"zip_with(_starts, {ends}, (_first, _last) -> {body})")


def blocks(text: Column, size: int = BLOCK) -> Column:
    """Cut a text into blocks of ``size`` code points, in one pass.

    ``substring`` walks from the start of the string each time; slicing from
    blocks keeps the cost of many slices independent of the text length.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}+"), F.lit(0))


def piece(cut: str, start: str, end: str, size: int = BLOCK) -> str:
    """SQL: code points ``start`` to ``end`` of a text cut by :func:`blocks`."""
    first, final = f"cast(floor({start} / {size}) AS int)", f"cast(floor(({end} - 1) / {size}) AS int)"
    joined = (
        f"CASE WHEN {first} = {final} THEN get({cut}, {first}) "
        f"ELSE array_join(slice({cut}, {first} + 1, {final} - {first} + 1), '') END"
    )
    return (
        f"CASE WHEN {start} >= {end} THEN '' "
        f"ELSE substring({joined}, {start} - {first} * {size} + 1, {end} - {start}) END"
    )
