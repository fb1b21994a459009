"""Recognizers: what to look for, and how sure a match makes us."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column

from spanveil.functions.spans import WORD_END, WORD_START

CONTEXT_BOOST = 0.35
CONTEXT_FLOOR = 0.4


@dataclass(frozen=True)
class Pattern:
    """One regular expression (Java syntax) with the score of its matches.

    ``guards`` are cheap tests a text must pass to have a match at all: a
    literal it must contain, or an expression starting with a bracket.
    """

    name: str
    regex: str
    score: float
    guards: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "score", float(self.score))
        if not 0 <= self.score <= 1:
            raise ValueError(f"pattern {self.name!r}: score must be between 0 and 1")
        if not self.regex:
            raise ValueError(f"pattern {self.name!r}: empty regular expression")
        try:
            matches_nothing = re.compile(self.regex).match("") is not None
        except re.error:
            matches_nothing = False  # Java syntax that Python does not know
        if matches_nothing:
            raise ValueError(f"pattern {self.name!r} matches the empty text")


@dataclass(frozen=True)
class Recognizer:
    """Patterns for one entity type.

    ``check`` tests a matched value; ``checked_score`` is the score of a match
    that passes (the pattern's own if None). ``languages`` None means any.
    """

    name: str
    entity_type: str
    patterns: tuple[Pattern, ...]
    context: tuple[str, ...] = ()
    languages: tuple[str, ...] | None = None
    check: Callable[[Column], Column] | None = field(default=None, compare=False)

    def __post_init__(self):
        if not self.entity_type:
            raise ValueError("a recognizer needs an entity type")
        if not self.patterns:
            raise ValueError(f"recognizer {self.name!r} has no patterns")

    def best_score(self, pattern: Pattern) -> float:
        """The highest score a match of ``pattern`` can get."""
        if not self.context:
            return pattern.score
        # rounded, so that 0.3 and 0.35 make 0.65 and meet a threshold of 0.65
        return round(min(1.0, max(pattern.score + CONTEXT_BOOST, CONTEXT_FLOOR)), 6)


def parse_list(value: str | Iterable[str] | None) -> tuple[str, ...]:
    """``"a, b"`` or a list as a tuple of trimmed, non-empty strings."""
    if value is None:
        return ()
    parts = value.split(",") if isinstance(value, str) else list(value)
    return tuple(p.strip() for p in parts if p.strip())


def create_patterns(names: Sequence[str], regexes: Sequence[str], scores: Sequence[float]) -> tuple[Pattern, ...]:
    """Patterns from parallel lists."""
    if not len(names) == len(regexes) == len(scores):
        raise ValueError("names, regexes and scores must have the same length")
    return tuple(Pattern(n, r, s) for n, r, s in zip(names, regexes, scores))


def regex_recognizer(
    entity_type: str,
    patterns: Iterable[Pattern],
    context: str | Iterable[str] | None = None,
    languages: Iterable[str] | None = None,
    name: str | None = None,
    unicode_classes: bool = False,
) -> Recognizer:
    """A custom recognizer; ``unicode_classes`` makes ``\\w`` and ``\\b`` know all letters."""
    made = tuple(patterns)
    if unicode_classes:
        made = tuple(Pattern(p.name, "(?U)" + p.regex, p.score, p.guards) for p in made)
    return Recognizer(
        name or f"{entity_type} regex", entity_type, made, parse_list(context),
        tuple(languages) if languages else None,
    )


def _branch(tails: list[str]) -> str:
    """An expression for sorted, distinct strings: what they have in common first, then one way per next letter.

    Longer strings are tried before shorter ones that begin them.
    """
    ends, ways = tails[0] == "", []
    rest = tails[1:] if ends else tails
    at = 0
    while at < len(rest):
        to = at + 1
        while to < len(rest) and rest[to][0] == rest[at][0]:
            to += 1
        head = os.path.commonprefix([rest[at], rest[to - 1]])  # of sorted strings, that of all between
        ways.append((head, _branch([x[len(head) :] for x in rest[at:to]]) if to > at + 1 else ""))
        at = to
    single = [h for h, more in ways if not more and len(h) == 1]
    parts = [re.escape(h) + more for h, more in ways if more or len(h) > 1]
    if single:
        parts.append(re.escape(single[0]) if len(single) == 1 else f"[{''.join(map(re.escape, single))}]")
    if not parts:
        return ""
    whole = parts[0] if len(parts) == 1 else "|".join(parts)
    if ends:
        return f"(?:{whole})?"
    return whole if len(parts) == 1 else f"(?:{whole})"


def alternatives(terms: Iterable[str]) -> str:
    """Literal terms as the expression of a prefix tree.

    A matcher tries one way per next letter, however many terms there are; of
    terms that begin alike, the longest that fits is taken.
    """
    wanted = sorted(set(terms))
    if not wanted or "" in wanted:
        raise ValueError("literal terms must not be empty")
    return _branch(wanted)


def terms_regex(terms: Iterable[str]) -> str:
    """Literal terms as one expression, whole words only."""
    return f"{WORD_START}(?:{alternatives(terms)}){WORD_END}"


def deny_list_recognizer(
    entity_type: str,
    terms: str | Iterable[str],
    score: float = 1.0,
    ignore_case: bool = False,
    languages: Iterable[str] | None = None,
) -> Recognizer:
    """Literal terms, some ten thousands at most; a list that is itself a table is a phrase table."""
    wanted = parse_list(terms)
    if not wanted:
        raise ValueError(f"deny list for {entity_type!r} is empty")
    regex = ("(?iu)" if ignore_case else "") + terms_regex(wanted)
    return Recognizer(
        f"{entity_type} deny list", entity_type, (Pattern("terms", regex, score),),
        languages=tuple(languages) if languages else None,
    )


def deny_list_recognizers(entity_types: Sequence[str], term_lists: Sequence[str | Iterable[str]]) -> list[Recognizer]:
    """Several deny lists, paired by position."""
    if len(entity_types) != len(term_lists):
        raise ValueError("one term list per entity type, please")
    return [deny_list_recognizer(e, t) for e, t in zip(entity_types, term_lists)]


def registry(predefined: Iterable[Recognizer], *custom: Iterable[Recognizer]) -> list[Recognizer]:
    """Custom recognizers are added to the predefined ones, not put in their place."""
    joined = list(predefined)
    for more in custom:
        joined.extend(more or ())
    return joined


def prune(
    recognizers: Iterable[Recognizer], entities: Iterable[str] | None = None, threshold: float = 0.0
) -> list[tuple[Recognizer, Pattern]]:
    """The patterns that can contribute a result, known before the job starts."""
    wanted = None if entities is None else {e.upper() for e in entities}
    return [
        (r, p)
        for r in recognizers
        if wanted is None or r.entity_type.upper() in wanted
        for p in r.patterns
        if r.best_score(p) >= threshold
    ]
