"""Sharding by jump consistent hashing (Lamping and Veach), in built-in expressions.

A key walks along an increasing list of shard numbers that only the key decides; the last one
below the number of shards is its shard.  One more shard therefore takes rows into itself and
moves none between the others, and there is no ring to store.

Nulls: a null key counts as 0, a null text as empty.  Rows may repeat: equal keys share a
shard, and each row has its own slot.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import in_blocks, running

# The published generator's multiplier and the sizes of its integers.
MULTIPLIER = 2862933555777941757
UNSIGNED = 1 << 64
HALF = 1 << 33
UNIT = float(1 << 31)

#: Steps taken for every key; a key walks about ln(shards) of them, and whoever needs more
#: goes on in a second walk that has as many steps as there are shards.
STEPS = 64


def _number(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def _walk(start: Column, shards: int, steps: int) -> Column:
    """Struct (key, here, past, next): the shard reached, the one before it, the next stop."""

    def step(at: Column, _: Column) -> Column:
        key = ((at["key"] * _number(MULTIPLIER) + 1) % _number(UNSIGNED)).cast("decimal(20,0)")
        moved = F.transform(
            F.array(key),
            lambda k: F.struct(
                k.alias("key"),
                at["next"].alias("here"),
                at["here"].alias("past"),
                F.floor(
                    (at["next"] + 1).cast("double")
                    * (F.lit(UNIT) / (F.floor(k / _number(HALF)).cast("double") + 1))
                )
                .cast("long")
                .alias("next"),
            ),
        )
        return F.when(at["next"] < shards, F.get(moved, F.lit(0))).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def jump(key: Column, shards: int) -> Column:
    """Struct (here, past): the shard among ``shards`` and the last stop before it (-1: none)."""
    signed = F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(38,0)")
    unsigned = F.when(signed < 0, signed + _number(UNSIGNED)).otherwise(signed)
    start = F.struct(
        unsigned.cast("decimal(20,0)").alias("key"),
        F.lit(-1).cast("long").alias("here"),
        F.lit(-1).cast("long").alias("past"),
        F.lit(0).cast("long").alias("next"),
    )
    first = _walk(start, shards, min(shards, STEPS))
    if shards > STEPS:
        first = F.get(
            F.transform(
                F.array(first),
                lambda at: F.when(at["next"] < shards, _walk(at, shards, shards)).otherwise(at),
            ),
            F.lit(0),
        )
    return first


def shard(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, that a stable integer key belongs to."""
    return jump(key, shards)["here"].cast("int")


def assign(
    docs: DataFrame, shards: int = 16, key: str = "doc_id", block_rows: int = 200_000
) -> DataFrame:
    """Every row's size, checksum, shard, slot in it and shard once there is one more.

    Slots follow (key, checksum, size) inside a shard.  Only these narrow columns are shuffled,
    and no shard is sorted whole: blocks of the key's order are numbered one by one.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        jump(F.col(key), shards + 1).alias("at"),
    )
    placed = narrow.select(
        "doc_id",
        "size",
        "text_crc32",
        F.when(F.col("at.here") == shards, F.col("at.past"))
        .otherwise(F.col("at.here"))
        .cast("int")
        .alias("shard"),
        F.col("at.here").cast("int").alias("grown_shard"),
    )
    order = ["doc_id", "text_crc32", "size"]
    cut = in_blocks(placed, order, "shards", block_rows)
    numbered = running(cut, ["shard"], order, F.lit(1), "slot")
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        "grown_shard",
    )
