"""Find personal data in text corpora on Spark, anonymize it and restore it."""

from spanveil.operators.analyze import analyze, decision_log, observe_decisions, span_rows
from spanveil.operators.anonymize import (
    Custom,
    Encrypt,
    Hash,
    Mask,
    Pseudonym,
    Redact,
    Replace,
    anonymize,
)
from spanveil.operators.deanonymize import deanonymize, reseal
from spanveil.operators.gazetteer import attach_spans, gazetteer_spans
from spanveil.operators.long_texts import analyze_long
from spanveil.operators.phrases import PhraseTable
from spanveil.operators.predefined import PREDEFINED, SUPPORTED_ENTITIES, recognizers_for
from spanveil.operators.recognizers import Pattern, Recognizer, deny_list_recognizer, regex_recognizer
from spanveil.plans.jobs import analyze_and_anonymize, anonymize_corpus
from spanveil.plans.options import AnalyzeOptions, EngineOptions, analyze_options, engine_options

__all__ = [
    "AnalyzeOptions", "Custom", "Encrypt", "EngineOptions", "Hash", "Mask", "PREDEFINED", "Pattern", "PhraseTable", "Pseudonym",
    "Recognizer", "Redact", "Replace", "SUPPORTED_ENTITIES", "analyze", "analyze_and_anonymize", "analyze_long", "analyze_options",
    "anonymize", "anonymize_corpus", "attach_spans", "deanonymize", "decision_log", "deny_list_recognizer",
    "engine_options", "gazetteer_spans", "observe_decisions", "recognizers_for", "regex_recognizer", "reseal", "span_rows",
]
