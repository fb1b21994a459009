"""Job options. All are checked before a job starts."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column

from spanveil.operators.phrases import PhraseTable
from spanveil.operators.predefined import PREDEFINED
from spanveil.operators.recognizers import (
    Pattern,
    Recognizer,
    deny_list_recognizers,
    parse_list,
    regex_recognizer,
    registry,
)


def _flag(value: Any) -> bool:
    if isinstance(value, str):
        text = value.strip().lower()
        if text in ("1", "true", "yes"):
            return True
        if text in ("0", "false", "no", "none", ""):
            return False
        raise ValueError(f"not a yes/no value: {value!r}")
    return bool(value)


def _score(value: Any) -> float:
    score = float(value or 0)
    if not 0 <= score <= 1:
        raise ValueError(f"a score must be between 0 and 1, not {value!r}")
    return score


def _object(value: Any) -> dict:
    return json.loads(value) if isinstance(value, str) else dict(value)


def _regex(value: Any) -> list[Recognizer]:
    """One regex recognizer, or a list of them, as JSON text or objects."""
    loaded = json.loads(value) if isinstance(value, str) else value
    out = []
    for spec in loaded if isinstance(loaded, (list, tuple)) else [loaded]:
        if isinstance(spec, Recognizer):
            out.append(spec)
            continue
        patterns = [Pattern(p["name_pattern"], p["regex"], p["score"]) for p in spec["pattern"]]
        out.append(regex_recognizer(spec["supported_entity"], patterns, spec.get("context")))
    return out


def _deny(value: Any) -> list[Recognizer]:
    if isinstance(value, (list, tuple)):
        return list(value)
    spec = _object(value)
    return deny_list_recognizers(spec["supported_entity"], spec["deny_list"])


@dataclass(frozen=True)
class EngineOptions:
    """What a job can find, and its default threshold.

    ``log_decision_process`` makes ``analyze`` add what became of every
    candidate.
    """

    recognizers: tuple[Recognizer, ...] = PREDEFINED
    regex: tuple[Recognizer, ...] = ()
    deny_list: tuple[Recognizer, ...] = ()
    log_decision_process: bool = False
    default_score_threshold: float = 0.0
    supported_languages: tuple[str, ...] | None = None
    phrase_tables: tuple[PhraseTable, ...] = ()

    def registry(self) -> list[Recognizer]:
        return registry(self.recognizers, self.regex, self.deny_list)


@dataclass(frozen=True)
class AnalyzeOptions:
    """How one job looks at its documents.

    ``entities`` and ``score_threshold`` may also be columns, when every
    document brings its own.
    """

    language: str = "en"
    entities: tuple[str, ...] | Column | None = None
    correlation_id: str | None = None
    score_threshold: float | Column = 0.0
    return_decision_process: bool = False
    ad_hoc_recognizers: tuple[Recognizer, ...] = ()


def _entities(value: Any) -> tuple[str, ...] | Column | None:
    if value is None or isinstance(value, Column):
        return value
    wanted = tuple(e.upper() for e in parse_list(value))
    return None if wanted in ((), ("NONE",)) else wanted


_ENGINE = {
    "regex": lambda v: tuple(_regex(v)),
    "deny_list": lambda v: tuple(_deny(v)),
    "log_decision_process": _flag,
    "default_score_threshold": _score,
    "supported_languages": lambda v: tuple(x.lower() for x in parse_list(v)) or None,
    "phrase_tables": lambda v: (v,) if isinstance(v, PhraseTable) else tuple(v),
}
_ANALYZE = {
    "language": lambda v: v.lower(),
    "entities": _entities,
    "correlation_id": lambda v: v,
    "score_threshold": lambda v: v if isinstance(v, Column) else _score(v),
    "return_decision_process": _flag,
    "ad_hoc_recognizers": lambda v: tuple(v or ()),
}
# accepted for compatibility; they name parts of a language model library
_IGNORED = ("nlp_engine", "app_tracer", "uuidClient")


def _with(options, known: dict, values: dict[str, Any]):
    changed = {}
    for name, value in values.items():
        if name in _IGNORED:
            continue
        if name not in known:
            raise ValueError(f"unknown option {name!r}; known: {sorted(known)}")
        if value is not None:
            changed[name] = known[name](value)
    return replace(options, **changed)


def engine_options(base: EngineOptions | None = None, **values: Any) -> EngineOptions:
    """Defaults with the given options laid over; strings are parsed."""
    return _with(base or EngineOptions(), _ENGINE, values)


def analyze_options(base: AnalyzeOptions | None = None, **values: Any) -> AnalyzeOptions:
    return _with(base or AnalyzeOptions(), _ANALYZE, values)
