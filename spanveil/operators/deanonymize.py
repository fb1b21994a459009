"""Deanonymize: put encrypted values back, given their keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import replacing
from spanveil.functions.arrays import once
from spanveil.functions.spans import inside, merge_overlaps, rewrite
from spanveil.operators.anonymize import DEFAULT, Encrypt, check_key, config_map, secrets
from spanveil.plans.stores import join_stores

FAILED = ("missing_key", "bad_key")


def attach_items(texts: DataFrame, items: DataFrame, id_col: str) -> DataFrame:
    """Join texts with items stored apart; one row per document on each side, or it is an error.

    Stores written with :func:`write_store` join without a shuffle.
    """
    return join_stores(texts, items, id_col)


def _ring(df: DataFrame, key_table: Mapping[str, str] | DataFrame | None) -> Column | None:
    """Keys by key id, as a scalar subquery."""
    if key_table is None:
        return None
    if isinstance(key_table, DataFrame):
        rows = key_table.where("key_id IS NOT NULL AND key IS NOT NULL").groupBy("key_id").agg(
            F.min("key").alias("key"), F.count_distinct("key").alias("n")
        )
        twice = F.when(F.max("n") > 1, F.raise_error(F.lit("a key id has more than one key")).cast("map<string,string>"))
        return rows.agg(F.coalesce(twice, F.map_from_entries(F.collect_list(F.struct("key_id", "key"))))).scalar()
    for key_id in key_table:
        Encrypt("k" * 16, key_id=key_id)
    return secrets(df.sparkSession, key_table)


def _openers(df: DataFrame, keys, key_table, mode: str, base64_key: bool) -> tuple[DataFrame, Column, Column | None]:
    """``_keys``: what opens a value of an entity type, a map to ``struct<key, mode, base64_key>``; and the keys by id."""
    ring = _ring(df, key_table)
    if ring is not None:
        df = df.withColumn("_ring", ring)
        ring = F.col("_ring")
    if isinstance(keys, DataFrame):
        df = df.withColumn("_ops", config_map(keys))
        own = lambda entity: F.try_element_at(F.col("_ops"), entity)

        def of(entity: Column) -> Column:
            return once(own(entity), lambda o: F.when(o.isNotNull(), F.struct(
                o["key"].alias("key"), F.upper(F.coalesce(o["mode"], F.lit(mode))).alias("mode"),
                F.coalesce(o["base64_key"], F.lit(base64_key)).alias("base64_key"),
            )))

        return df, of, ring
    if not keys and ring is None:
        raise ValueError("restoring needs at least one key")
    ops = {}
    for name, key in (keys or {}).items():
        ops[name] = key if isinstance(key, Encrypt) else Encrypt(key, mode, base64_key)
        check_key(ops[name].key, ops[name].base64_key)
    if not ops:
        return df, lambda entity: F.lit(None).cast("struct<key:string,mode:string,base64_key:boolean>"), ring
    df = df.withColumn("_ops", secrets(df.sparkSession, {n: o.key for n, o in ops.items()}))

    def of(entity: Column) -> Column:
        how = F
        for name, op in ops.items():
            how = how.when(entity == name, F.struct(
                F.try_element_at(F.col("_ops"), F.lit(name)).alias("key"), F.lit(op.mode).alias("mode"), F.lit(op.base64_key).alias("base64_key")
            ))
        return how

    return df, of, ring


def _opened(value: Column, entity: Column, of, ring: Column | None) -> Column:
    """``struct<status, text>``: the plain text, or why there is none.

    A value in an envelope is opened by the key it names; any other by the
    key of its entity type.
    """

    def result(found: Column, plain: Column) -> Column:
        return once(plain, lambda p: F.struct(
            F.when(found.isNull(), "missing_key").when(p.isNull(), "bad_key").otherwise("decrypt").alias("status"), p.alias("text")
        ))

    def bare(_: Column) -> Column:
        return once(
            F.coalesce(of(entity), of(F.lit(DEFAULT))),
            lambda k: result(k["key"], replacing.decrypt(value, k["key"], k["mode"], k["base64_key"])),
        )

    if ring is None:
        return bare(value)

    def inner(e: Column) -> Column:
        named = once(
            F.try_element_at(ring, e["key_id"]), lambda key: result(key, replacing.decrypt(e["sealed"], key, e["mode"], e["base64_key"]))
        )
        return F.when(e.isNotNull(), named).otherwise(bare(value))

    return once(replacing.envelope(value), inner)


def deanonymize(
    df: DataFrame,
    keys: Mapping[str, str | Encrypt] | DataFrame | None = None,
    text_col: str = "anonymized_text",
    items_col: str = "items",
    out_col: str = "restored_text",
    out_items_col: str = "restored_items",
    mode: str = "CBC",
    base64_key: bool = False,
    key_table: Mapping[str, str] | DataFrame | None = None,
) -> DataFrame:
    """Add the restored text, the restored items (last first) and a ``status``.

    ``keys`` are by entity type: texts, operators with a mode of their own, or
    a config table. ``key_table`` has keys by key id, for values that name
    theirs; such values can be of any keys and modes, side by side. ``mode``
    and ``base64_key`` are for keys that don't say.

    Only items of the operator ``encrypt`` are touched. A value without a key
    stays as it is (``missing_key``), and so does one that its key does not
    open (``bad_key``).
    """
    df, of, ring = _openers(df, keys, key_table, mode, base64_key)
    text, items = F.col(text_col), F.col(items_col)
    sealed = F.transform(
        F.filter(items, lambda i: i["operator"] == "encrypt"),
        lambda i: F.struct(
            i["start"].alias("start"), i["end"].alias("end"),
            i["entity_type"].alias("entity_type"), F.lit(1.0).alias("score"),
        ),
    )

    def replace(s: Column, value: Column) -> Column:
        return once(
            _opened(value, s["entity_type"], of, ring),
            lambda o: F.struct(o["status"].alias("operator"), F.coalesce(o["text"], value).alias("text")),
        )

    ready = text.isNotNull() & items.isNotNull()
    done = F.when(ready, rewrite(text, merge_overlaps(inside(sealed, text)), replace))
    left = lambda name: F.exists(F.col("_done.items"), lambda i: i["operator"] == name)
    status = (
        F.when(text.isNull(), "missing_text")
        .when(items.isNull(), "missing_items")
        .when(left("missing_key"), "missing_key")
        .when(left("bad_key"), "bad_key")
        .otherwise("ok")
    )
    return (
        df.withColumn("_done", done)
        .withColumns(
            {
                out_col: F.col("_done.text"),
                out_items_col: F.filter(F.col("_done.items"), lambda i: i["operator"] == "decrypt"),
                "status": status,
            }
        )
        .drop("_done", "_ops", "_ring")
    )


def reseal(
    df: DataFrame,
    new: Encrypt,
    key_table: Mapping[str, str] | DataFrame | None = None,
    keys: Mapping[str, str | Encrypt] | DataFrame | None = None,
    text_col: str = "anonymized_text",
    items_col: str = "items",
    id_col: str | None = None,
    mode: str = "CBC",
    base64_key: bool = False,
) -> DataFrame:
    """Seal encrypted values anew under another key, without restored texts in between.

    Values are opened as by :func:`deanonymize` and sealed by ``new``, which
    needs a ``key_id``. Values that already name it are left alone, and so are
    those that don't open; the ``status`` says why. The offsets of all items,
    of other operators too, follow.
    """
    if new.key_id is None:
        raise ValueError("the new key needs a key_id")
    df, of, ring = _openers(df, keys, key_table, mode, base64_key)
    df = df.withColumn("_new", secrets(df.sparkSession, {"new": new.key}))
    text, items = F.col(text_col), F.col(items_col)
    doc = F.col(id_col).cast("string") if id_col else F.lit("")

    def replace(s: Column, value: Column) -> Column:
        def again(o: Column) -> Column:
            place = F.concat_ws(":", doc, s["start"].cast("string"))
            made = replacing.in_envelope(
                replacing.encrypt(o["text"], F.col("_new")["new"], place, new.mode, new.base64_key), new.key_id, new.mode, new.base64_key
            )
            good = o["status"] == "decrypt"
            return F.struct(F.when(good, "encrypt").otherwise(o["status"]).alias("operator"), F.when(good, made).otherwise(value).alias("text"))

        kept = F.struct(s["operator"].alias("operator"), value.alias("text"))
        done = F.startswith(value, F.lit(f"{replacing.ENVELOPE}.{new.key_id}."))
        return F.when((s["operator"] != "encrypt") | done, kept).otherwise(once(_opened(value, s["entity_type"], of, ring), again))

    ordered = F.array_sort(F.transform(items, lambda i: F.struct(*[i[f].alias(f) for f in ("start", "end", "entity_type", "operator")])))
    ready = text.isNotNull() & items.isNotNull()
    left = lambda name: F.exists(F.col("_done.items"), lambda i: i["operator"] == name)
    status = (
        F.when(text.isNull(), "missing_text").when(items.isNull(), "missing_items")
        .when(left("missing_key"), "missing_key").when(left("bad_key"), "bad_key").otherwise("ok")
    )
    named = F.transform(
        "_done.items",
        lambda i: F.struct(
            F.when(i["operator"].isin(*FAILED), "encrypt").otherwise(i["operator"]).alias("operator"),
            *[i[f].alias(f) for f in ("entity_type", "start", "end", "text")],
        ),
    )
    return (
        df.withColumn("_done", F.when(ready, rewrite(text, ordered, replace, ("operator",))))
        .withColumns({text_col: F.coalesce(F.col("_done.text"), text), items_col: F.coalesce(named, items), "status": status})
        .drop("_done", "_ops", "_ring", "_new")
    )
