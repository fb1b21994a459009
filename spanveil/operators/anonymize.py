"""Anonymize: rewrite texts by their spans, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions import replacing
from spanveil.functions.arrays import once
from spanveil.functions.spans import inside, merge_overlaps, rewrite

DEFAULT = "DEFAULT"
OPERATOR_NAMES = ("replace", "redact", "mask", "hash", "encrypt", "custom", "pseudonym")
PARAMS_TYPE = (
    "struct<type:string,new_value:string,hash_type:string,key:string,masking_char:string,"
    "chars_to_mask:int,from_end:boolean,mode:string,base64_key:boolean,key_id:string,salt:string>"
)


@dataclass(frozen=True)
class Replace:
    """Replace with ``new_value``, or with the entity type in angle brackets."""

    new_value: str | None = None
    name: str = field(default="replace", init=False)


@dataclass(frozen=True)
class Redact:
    name: str = field(default="redact", init=False)


@dataclass(frozen=True)
class Mask:
    masking_char: str
    chars_to_mask: int
    from_end: bool = False
    name: str = field(default="mask", init=False)

    def __post_init__(self):
        if len(self.masking_char) != 1:
            raise ValueError("masking_char must be one character")
        if int(self.chars_to_mask) < 0:
            raise ValueError("chars_to_mask must not be negative")


@dataclass(frozen=True)
class Hash:
    hash_type: str = "sha256"
    name: str = field(default="hash", init=False)

    def __post_init__(self):
        if self.hash_type not in replacing.HASHES:
            raise ValueError(f"hash_type must be one of {replacing.HASHES}")


def check_key(key: str, base64_key: bool = False) -> None:
    import base64

    size = len(base64.b64decode(key)) if base64_key else len(key.encode("utf-8"))
    if size not in (16, 24, 32):
        raise ValueError("a key must have 128, 192 or 256 bits")


@dataclass(frozen=True)
class Encrypt:
    """AES. CBC, or GCM, which also notices a wrong key for sure.

    With a ``key_id`` every sealed value names its key, mode and form of key,
    so that values of several keys and modes can stand in one text.
    """

    key: str = field(repr=False)
    mode: str = "CBC"
    base64_key: bool = False
    key_id: str | None = None
    name: str = field(default="encrypt", init=False)

    def __post_init__(self):
        if self.key_id is not None and not re.fullmatch(replacing.KEY_ID, self.key_id):
            raise ValueError("a key id has 1 to 64 letters, digits, hyphens and underscores")
        if self.mode not in replacing.MODES:
            raise ValueError(f"mode must be one of {sorted(replacing.MODES)}")
        check_key(self.key, self.base64_key)


@dataclass(frozen=True)
class Custom:
    """Any column expression of the value; not a Python function of rows."""

    function: Callable[[Column], Column]
    name: str = field(default="custom", init=False)


@dataclass(frozen=True)
class Pseudonym:
    """The same name for the same value everywhere in the corpus."""

    salt: str = field(repr=False)
    name: str = field(default="pseudonym", init=False)


Operator = Replace | Redact | Mask | Hash | Encrypt | Custom | Pseudonym


def secrets(spark: SparkSession, values: Mapping[str, str]) -> Column:
    """A map of secrets as a scalar subquery.

    As literals they would be readable in every plan and event log.
    """
    table = pa.table(
        {"name": pa.array(list(values), pa.string()), "secret": pa.array(list(values.values()), pa.string())}
    )
    rows = spark.createDataFrame(table)
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("name", "secret")))).scalar()


def config_map(config: DataFrame) -> Column:
    """A config table (one row per entity type) as a scalar subquery."""
    params = [f.split(":")[0] for f in PARAMS_TYPE[len("struct<"):-1].split(",")]
    absent = [c for c in params if c not in config.columns]
    if "status" in config.columns:
        config = config.where("status = 'ok'")
    if "seq" in config.columns:  # the last one written wins
        config = config.groupBy("entity_type").agg(
            F.max_by(F.struct(*[c for c in config.columns if c not in ("entity_type", "seq")]), "seq").alias("_c")
        ).select("entity_type", "_c.*")
    full = config.dropDuplicates(["entity_type"]).select(
        "entity_type", *[F.lit(None).alias(c) if c in absent else F.col(c) for c in params]
    )
    entry = F.struct("entity_type", F.struct(*params).cast(PARAMS_TYPE).alias("params"))
    named = full.where(F.col("entity_type").isNotNull())
    return named.agg(F.map_from_entries(F.collect_list(entry))).scalar()


def config_versions(config: DataFrame) -> Column:
    """A config table with ``valid_from``: a map from entity type to its versions in order, as a scalar subquery.

    Of lines that are valid from the same time the one with the largest
    ``seq`` counts, where there is such a column. A line without a time is
    valid always.
    """
    params = [f.split(":")[0] for f in PARAMS_TYPE[len("struct<"):-1].split(",")]
    if "status" in config.columns:
        config = config.where("status = 'ok'")
    fields = F.struct(*[F.col(c) if c in config.columns else F.lit(None).alias(c) for c in params]).cast(PARAMS_TYPE)
    start = F.coalesce(F.col("valid_from").cast("timestamp"), F.to_timestamp(F.lit("0001-01-01 00:00:00"))).alias("valid_from")
    rows = config.where("entity_type IS NOT NULL").select("entity_type", start, fields.alias("params"), *(["seq"] if "seq" in config.columns else []))
    latest = F.max_by("params", "seq") if "seq" in config.columns else F.first("params")
    one = rows.groupBy("entity_type", "valid_from").agg(latest.alias("params"))
    versions = one.groupBy("entity_type").agg(F.sort_array(F.collect_list(F.struct("valid_from", "params"))).alias("versions"))
    return versions.agg(F.map_from_entries(F.collect_list(F.struct("entity_type", "versions")))).scalar()


def _version(ops: Column, entity_type: Column, time: Column) -> Column:
    """The last version of an entity type, or else of the default, that was valid at ``time``."""
    def of(name: Column) -> Column:
        known = F.filter(F.try_element_at(ops, name), lambda v: v["valid_from"] <= time)
        return F.try_element_at(known, F.lit(-1))["params"]

    return F.coalesce(of(entity_type), of(F.lit(DEFAULT)))


def _outcome(operator: Column, text: Column) -> Column:
    return F.struct(operator.alias("operator"), text.alias("text"))


def _by_python(operators: Mapping[str, Operator], secret: Column | None, doc: Column):
    """The replacement of one span, from a Python mapping."""
    default = operators.get(DEFAULT, Replace())

    def apply(name: str, op: Operator, s: Column, value: Column) -> Column:
        match op:
            case Replace():
                text = replacing.placeholder(s["entity_type"]) if op.new_value is None else F.lit(op.new_value)
            case Redact():
                text = F.lit("")
            case Mask():
                text = replacing.mask(value, F.lit(op.masking_char), F.lit(int(op.chars_to_mask)), F.lit(op.from_end))
            case Hash():
                text = replacing.hashed(value, op.hash_type)
            case Encrypt():
                place = F.concat_ws(":", doc, s["start"].cast("string"))
                text = replacing.encrypt(value, secret[name], place, op.mode, op.base64_key)
                if op.key_id is not None:
                    text = replacing.in_envelope(text, op.key_id, op.mode, op.base64_key)
            case Pseudonym():
                text = replacing.pseudonym(s["entity_type"], value, secret[name])
            case Custom():
                text = op.function(value).cast("string")
        # a replacement of NULL never deletes what stands around, nor leaves the value
        return _outcome(F.lit(op.name), F.coalesce(text, replacing.placeholder(s["entity_type"])))

    def replace(s: Column, value: Column) -> Column:
        named = [(n, op) for n, op in operators.items() if n != DEFAULT]
        fallback = apply(DEFAULT, default, s, value)
        if not named:
            return fallback
        choice = F
        for name, op in named:
            choice = choice.when(s["entity_type"] == name, apply(name, op, s, value))
        return choice.otherwise(fallback)

    return replace


def _of_type(ops: Column, entity_type: Column) -> Column:
    return F.coalesce(F.try_element_at(ops, entity_type), F.try_element_at(ops, F.lit(DEFAULT)))


def _form(op: Column, mode: str, base64_key: bool) -> tuple[Column, Column]:
    """Mode and form of key of a config line; what it leaves open is given."""
    return F.upper(F.coalesce(op["mode"], F.lit(mode))), F.coalesce(op["base64_key"], F.lit(base64_key))


def _usable(op: Column, mode: str, base64_key: bool) -> Column:
    """Whether a config line can be carried out."""
    kind, (how, form) = op["type"], _form(op, mode, base64_key)
    named = op["key_id"].isNull() | op["key_id"].rlike(f"^{replacing.KEY_ID}$")
    return (
        F.when(kind.isin("redact", "replace"), True)
        .when(kind == "mask", (F.length(op["masking_char"]) == 1) & (op["chars_to_mask"] >= 0))
        .when(kind == "hash", F.coalesce(op["hash_type"], F.lit("sha256")).isin(*replacing.HASHES))
        .when(kind == "encrypt", replacing.fits(op["key"], form) & how.isin(*replacing.MODES) & named)
        .when(kind == "pseudonym", op["salt"].isNotNull())
        .otherwise(False)
    )


def _by_table(of: Callable[[Column], Column], doc: Column, mode: str, base64_key: bool):
    """The replacement of one span, from a config table; ``of`` gives the line of an entity type."""

    def replace(s: Column, value: Column) -> Column:
        def apply(op: Column) -> Column:
            kind, (how, form) = op["type"], _form(op, mode, base64_key)
            place = F.concat_ws(":", doc, s["start"].cast("string"))
            hashes = F.when(op["hash_type"] == "md5", replacing.hashed(value, "md5")).when(
                op["hash_type"] == "sha512", replacing.hashed(value, "sha512")
            ).otherwise(replacing.hashed(value, "sha256"))
            sealed = replacing.encrypt(value, op["key"], place, how, form)
            text = (
                F.when(kind == "redact", F.lit(""))
                .when(
                    kind == "mask",
                    replacing.mask(
                        value, op["masking_char"], op["chars_to_mask"], F.coalesce(op["from_end"], F.lit(False))
                    ),
                )
                .when(kind == "hash", hashes)
                .when(
                    kind == "encrypt",
                    F.when(op["key_id"].isNull(), sealed).otherwise(replacing.in_envelope(sealed, op["key_id"], how, form)),
                )
                .when(kind == "pseudonym", replacing.pseudonym(s["entity_type"], value, op["salt"]))
                .when(kind == "replace", op["new_value"])
            )
            text = F.when(_usable(op, mode, base64_key), text)
            # a config line that cannot be carried out never leaves the value as it is
            known = kind.isin("redact", "mask", "hash", "encrypt", "pseudonym") & text.isNotNull()
            return _outcome(
                F.when(known, kind).otherwise("replace"),
                F.coalesce(text, replacing.placeholder(s["entity_type"])),
            )

        return once(of(s["entity_type"]), apply)

    return replace


def anonymize(
    df: DataFrame,
    operators: Mapping[str, Operator] | DataFrame | None = None,
    text_col: str = "text",
    spans_col: str = "spans",
    id_col: str | None = None,
    out_col: str = "anonymized_text",
    items_col: str = "items",
    mode: str = "CBC",
    base64_key: bool = False,
    as_of: str | None = None,
) -> DataFrame:
    """Add the rewritten text, the items (last first) and a ``status``.

    ``operators`` maps entity types to operators, or is a config table with
    one row per entity type; ``mode`` and ``base64_key`` are for lines of the
    table that don't say. A line that cannot be carried out (a ``custom``
    operator, a bad key) gives the entity type in place of the value and the
    status ``bad_operator``. Types without an operator get the ``DEFAULT`` one, which is
    replacement by the entity type. With ``as_of``, a column of times, every
    document gets the lines of the table that were valid then (their
    ``valid_from``), whatever was added later. Overlapping spans are merged first, so no
    part of a detected value stays.
    """
    doc = F.col(id_col).cast("string") if id_col else F.lit("")
    text, spans, failing = F.col(text_col), F.col(spans_col), None
    if isinstance(operators, DataFrame):
        if as_of is None:
            df = df.withColumn("_ops", config_map(operators))
            of = lambda entity: _of_type(F.col("_ops"), entity)
        else:
            df = df.withColumn("_ops", config_versions(operators))
            of = lambda entity: _version(F.col("_ops"), entity, F.col(as_of))
        replace = _by_table(of, doc, mode, base64_key)

        def unusable(s: Column) -> Column:
            return once(
                of(s["entity_type"]),
                lambda op: op.isNotNull() & ~F.coalesce(_usable(op, mode, base64_key), F.lit(False)),
            )

        failing = F.exists(spans, unusable)
    else:
        if as_of is not None:
            raise ValueError("only the lines of a config table have a time")
        operators = dict(operators or {})
        for name, op in operators.items():
            if not isinstance(op, Operator):
                raise ValueError(f"not an operator for {name!r}: {op!r}")
        hidden = {
            n: op.key if isinstance(op, Encrypt) else op.salt
            for n, op in operators.items()
            if isinstance(op, (Encrypt, Pseudonym))
        }
        if hidden:
            df = df.withColumn("_ops", secrets(df.sparkSession, hidden))
        replace = _by_python(operators, F.col("_ops") if hidden else None, doc)

    islands = merge_overlaps(inside(spans, text))
    outside = F.exists(
        spans,
        lambda s: s["start"].isNull() | s["end"].isNull() | (s["start"] < 0) | (s["end"] > F.length(text)) | (s["start"] >= s["end"]),
    )
    ready = text.isNotNull() & spans.isNotNull()
    status = F.when(text.isNull(), "missing_text").when(spans.isNull(), "missing_spans")
    if "status" in df.columns:
        status = status.when(F.col("status") != "ok", F.col("status"))
    if failing is not None:
        status = status.when(failing, "bad_operator")
    status = status.when(outside, "clipped_spans").otherwise("ok")
    return (
        df.withColumns({"_done": F.when(ready, rewrite(text, islands, replace)), "status": status})
        .withColumns({out_col: F.col("_done.text"), items_col: F.col("_done.items")})
        .drop("_done", "_ops")
    )
