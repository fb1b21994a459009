"""Configuration files: operators per entity type, engine and analyze options."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators.anonymize import (
    OPERATOR_NAMES,
    PARAMS_TYPE,
    Custom,
    Encrypt,
    Hash,
    Mask,
    Operator,
    Pseudonym,
    Redact,
    Replace,
)
from spanveil.plans.options import AnalyzeOptions, EngineOptions, analyze_options, engine_options

# A config that becomes Python operators has at most so many entity types.
MOST_TYPES = 10_000
STRICT = {"allowSingleQuotes": "false"}
REGEX_TYPE = (
    "struct<supported_entity:string,pattern:array<struct<name_pattern:string,regex:string,score:string>>,"
    "context:string>"
)
DENY_TYPE = "struct<supported_entity:array<string>,deny_list:array<string>>"
ENGINE_TYPE = (
    "uuidClient string, regex string, deny_list string, nlp_engine string, app_tracer string, "
    "log_decision_process string, default_score_threshold string, supported_languages string"
)
ANALYZE_TYPE = (
    "uuidClient string, language string, correlation_id string, score_threshold string, entities string, "
    "return_decision_process string"
)


def read_operator_config(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{entity_type, params}``, ``params`` being JSON text.

    ``seq`` orders lines by the time their file was written, its name and the
    place in it, so that what is appended comes last; ``status`` is
    ``malformed`` where a line or its parameters cannot be read.
    """
    meta = F.col("_metadata")
    place = F.struct(
        meta["file_modification_time"].alias("written"), meta["file_name"].alias("file"),
        meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"),
    )
    lines = spark.read.text(path).select(
        place.alias("seq"),
        F.from_json("value", "struct<entity_type:string,params:string>").alias("l"),
    )
    parsed = lines.select("seq", "l.entity_type", F.from_json("l.params", PARAMS_TYPE).alias("p"))
    # a custom operator is a function; a line cannot name one
    storable = [n for n in OPERATOR_NAMES if n != "custom"]
    known = F.col("p.type").isin(*storable, "decrypt") & F.col("entity_type").isNotNull()
    return parsed.select(
        "seq", "entity_type", "p.*", F.when(known, "ok").otherwise("malformed").alias("status")
    )


def latest_config(config: DataFrame) -> DataFrame:
    """One row per entity type: the last one written wins, on the exact name."""
    fields = [c for c in config.columns if c not in ("entity_type", "seq")]
    if "status" in config.columns:
        config = config.where("status = 'ok'")
    return (
        config.groupBy("entity_type")
        .agg(F.max_by(F.struct(*fields), "seq").alias("_c"))
        .select("entity_type", "_c.*")
    )


def show_config(config: DataFrame) -> DataFrame:
    """The table without its keys and salts."""
    hidden = {c: F.when(F.col(c).isNotNull(), "***") for c in ("key", "salt") if c in config.columns}
    return config.withColumns(hidden) if hidden else config


def upsert_operator(config: Mapping[str, Operator], entity_type: str, operator: Operator) -> dict[str, Operator]:
    """A config with one entity type set; any other one of that type is gone."""
    if not entity_type:
        raise ValueError("an operator needs an entity type")
    if not isinstance(operator, Operator):
        raise ValueError(f"not an operator: {operator!r}")
    return {**config, entity_type: operator}


def operator_lines(config: Mapping[str, Operator], decrypt: bool = False) -> list[str]:
    lines = []
    for entity_type, op in config.items():
        if isinstance(op, Custom):
            raise ValueError("a custom operator is a function and cannot be stored")
        params = {("type" if k == "name" else k): v for k, v in asdict(op).items() if v is not None}
        if decrypt:
            if not isinstance(op, Encrypt):
                raise ValueError(f"the operator of {entity_type!r} does not encrypt")
            params["type"] = "decrypt"
        lines.append(json.dumps({"entity_type": entity_type, "params": json.dumps(params)}))
    return lines


def write_operator_config(
    spark: SparkSession, config: Mapping[str, Operator], path: str, decrypt: bool = False, mode: str = "overwrite"
) -> None:
    """Store a config as JSON lines; an empty one resets it."""
    rows = [(line,) for line in operator_lines(config, decrypt)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode(mode).text(path)


def load_operators(config: DataFrame) -> dict[str, Operator]:
    """A (small) config table as Python operators, checked one by one."""
    made: dict[str, Operator] = {}
    rows = latest_config(config).limit(MOST_TYPES + 1).collect()
    if len(rows) > MOST_TYPES:
        raise ValueError(f"a config of more than {MOST_TYPES} entity types stays a table")
    for r in rows:
        if r["status"] != "ok":
            raise ValueError(f"operator config for {r['entity_type']!r} cannot be read")
        match r["type"]:
            case "replace":
                made[r["entity_type"]] = Replace(r["new_value"])
            case "redact":
                made[r["entity_type"]] = Redact()
            case "mask":
                made[r["entity_type"]] = Mask(r["masking_char"], r["chars_to_mask"], bool(r["from_end"]))
            case "hash":
                made[r["entity_type"]] = Hash(r["hash_type"] or "sha256")
            case "encrypt" | "decrypt":
                made[r["entity_type"]] = Encrypt(r["key"], r["mode"] or "CBC", bool(r["base64_key"]), r["key_id"])
            case "pseudonym":
                made[r["entity_type"]] = Pseudonym(r["salt"])
            case other:
                raise ValueError(f"operator {other!r} cannot be stored in a config")
    return made


def read_engine_options(spark: SparkSession, path: str) -> DataFrame:
    """Engine option files, with ``regex`` and ``deny_list`` checked.

    Rows whose inner JSON is broken have the status ``malformed``.
    """
    raw = spark.read.schema(ENGINE_TYPE).option("multiLine", True).json(path)
    regex = F.from_json("regex", REGEX_TYPE, STRICT)
    deny = F.from_json("deny_list", DENY_TYPE, STRICT)
    whole_regex = (
        F.col("_regex.supported_entity").isNotNull()
        & (F.size(F.coalesce(F.col("_regex.pattern"), F.array())) > 0)
        & F.forall("_regex.pattern", lambda p: p["regex"].isNotNull() & p["score"].try_cast("double").between(0, 1))
    )
    whole_deny = F.size("_deny.supported_entity") == F.size("_deny.deny_list")
    good = (F.col("regex").isNull() | F.coalesce(whole_regex, F.lit(False))) & (
        F.col("deny_list").isNull() | F.coalesce(whole_deny, F.lit(False))
    )
    return (
        raw.withColumns({"_regex": regex, "_deny": deny})
        .withColumn("status", F.when(good, "ok").otherwise("malformed"))
        .drop("_regex", "_deny")
    )


def read_analyze_options(spark: SparkSession, path: str) -> DataFrame:
    """Analyze option files with parsed lists; ``entities`` NULL means all."""
    raw = spark.read.schema(ANALYZE_TYPE).option("multiLine", True).json(path)
    listed = F.filter(
        F.transform(F.split(F.upper("entities"), ","), lambda e: F.trim(e)), lambda e: e != ""
    )
    wanted = F.when(F.upper(F.trim("entities")) != "NONE", listed)
    return raw.select(
        "uuidClient",
        F.lower(F.coalesce("language", F.lit("en"))).alias("language"),
        "correlation_id",
        F.coalesce(F.col("score_threshold").try_cast("double"), F.lit(0.0)).alias("score_threshold"),
        F.when(F.size(wanted) > 0, wanted).alias("entities"),
        F.lower(F.coalesce("return_decision_process", F.lit("0"))).isin("1", "true").alias("return_decision_process"),
    )


def _one(options: DataFrame, request: str) -> dict:
    rows = options.where(F.col("uuidClient") == request).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} option files for request {request!r}")
    return rows[0].asDict()


def load_engine_options(options: DataFrame, request: str) -> EngineOptions:
    """The engine options of one request, laid over the defaults."""
    row = _one(options, request)
    if row.pop("status") != "ok":
        raise ValueError(f"engine options of request {request!r} cannot be read")
    return engine_options(**row)


def load_analyze_options(options: DataFrame, request: str) -> AnalyzeOptions:
    return analyze_options(**_one(options, request))
