"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import free_name

SLOTS = 4099  # prime, over a hundred times the usual number of shards


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The number of a shard for each slot.

    Each shard prefers the slots in an order of its own: an offset and a step,
    both hashed from its name; with a prime number of slots any step visits
    all. The shards take turns, each claiming its next free slot. A shard that
    joins or leaves changes few slots of the others.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if slots < len(shards) or slots < 3 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime, and as many as shards at least")
    at = [_number(f"offset {x}") % slots for x in shards]
    step = [_number(f"step {x}") % (slots - 1) + 1 for x in shards]
    owner, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key's string form; NULL is a key of its own."""
    digest = F.md5(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def place(
    df: DataFrame, key: Column, shards: Sequence[str], *, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard"
) -> DataFrame:
    """``df`` with the slot and the shard of each row; all other columns stay.

    The table has ``slots`` rows, however large ``df`` is, and is broadcast: no
    row of ``df`` moves. Equal keys go to one shard, NULL keys too. Columns
    named as the two results are replaced. An empty table stays empty.
    """
    owners = F.array(*[F.lit(x) for x in shards])
    numbers = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    spark = df.sparkSession
    placed = df.withColumn(slot_col, slot_of(key, slots))
    at, to = free_name(placed, "table_slot"), free_name(placed, "table_shard")
    table = spark.range(1).select(F.posexplode(numbers).alias("at", "owner"))
    table = table.select(F.col("at").cast("long").alias(at), F.get(owners, F.col("owner").cast("int")).alias(to))
    joined = placed.join(F.broadcast(table), F.col(slot_col) == F.col(at))
    return joined.withColumn(shard_col, F.col(to)).drop(at, to)


def write_shards(placed: DataFrame, path: str, shard_col: str = "shard") -> None:
    """One folder for each shard, written where the rows lie."""
    placed.write.partitionBy(shard_col).parquet(path)
