"""Joins against dimension tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.operators.timeline import (
    HOT_ROWS,
    STRETCH,
    known_hot,
    null_safe_join,
    with_stretch,
)


def lookup_join(fact: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join to a dimension with one row per key.

    There is no broadcast hint: Spark broadcasts the dimension, as it is, when its size is under
    ``spark.sql.autoBroadcastJoinThreshold`` (static estimate, or the size AQE measured).
    Beyond that the join shuffles, and AQE cuts the partitions hot keys fall into by measured
    size, into as many parts as they need; nothing is repeated for keys that are not hot.
    The session has it do so even where a later aggregate on the same keys then has to shuffle
    (``spark.sql.adaptive.forceOptimizeSkewedJoin``, see :mod:`wattframe.session`).
    """
    return fact.join(dim, list(on), "left")


def asof_lookup(
    fact: DataFrame,
    history: DataFrame,
    key: Column,
    history_key: Column,
    values: Mapping[str, Column],
    tie: Sequence[str],
    time: str = "ts_us",
    history_time: str = "ts_us",
    hot_rows: int = HOT_ROWS,
    fact_rows: DataFrame | None = None,
) -> DataFrame:
    """Attaches the values of the latest history row at or before each fact row.

    Facts and history become one timeline per key along which the last value is carried: no
    inequality join, no pairs.  A key with many facts is cut into stretches of time.
    History times are unique within a key; ``tie`` makes facts with equal times distinct;
    history comes before facts at a tie.  ``fact_rows`` are numbers of facts (``_key``,
    ``_rows``, several entries per key add up) where the caller has them from a narrower source.
    """
    part = ["_key", STRETCH]
    facts = fact.select(
        F.struct(*fact.columns).alias("_row"),
        key.alias("_key"),
        F.col(time).alias("_time"),
        F.lit(1).alias("_rank"),
        F.struct(*tie).alias("_tie"),
    )
    marks = history.select(
        history_key.alias("_key"),
        F.col(history_time).alias("_time"),
        F.lit(0).alias("_rank"),
        F.struct(*[v.alias(n) for n, v in values.items()]).alias("_state"),
    )
    # a key with many states is as busy as one with many facts
    one = F.lit(1).cast("bigint").alias("_rows")
    entries = (facts.select("_key", one) if fact_rows is None else fact_rows).unionByName(
        marks.select("_key", one)
    )
    counts = entries.groupBy("_key").agg(F.sum("_rows").alias("_rows"))
    both = facts.select("_key", "_time").unionByName(marks.select("_key", "_time"))
    hot = known_hot(both, ["_key"], "_time", hot_rows, counts)
    if hot is None:
        so_far = (
            Window.partitionBy("_key").orderBy("_time", "_rank", "_tie").rowsBetween(Window.unboundedPreceding, 0)
        )
        found = (
            facts.unionByName(marks, allowMissingColumns=True)
            .withColumn("_found", F.last("_state", ignorenulls=True).over(so_far))
            .where(F.col("_rank") == 1)
        )
        return found.select("_row.*", *[F.col("_found")[n].alias(n) for n in values])

    def cut(rows: DataFrame, only_hot: bool = False) -> DataFrame:
        return with_stretch(rows, ["_key"], "_time", hot, only_hot)

    so_far = (
        Window.partitionBy(*part)
        .orderBy("_time", "_rank", "_tie")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = (
        cut(facts)
        .unionByName(cut(marks), allowMissingColumns=True)
        .withColumn("_found", F.last("_state", ignorenulls=True).over(so_far))
        .where(F.col("_rank") == 1)
    )

    # state at the start of each stretch of a hot key that has facts
    wanted = cut(facts, only_hot=True).select(*part).distinct()
    ends = cut(marks, only_hot=True).groupBy(*part).agg(F.max_by("_state", "_time").alias("_end"))
    earlier = (
        Window.partitionBy("_key").orderBy(STRETCH).rangeBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        wanted.withColumn("_wanted", F.lit(True))
        .unionByName(ends, allowMissingColumns=True)
        .withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier))
        .where("_wanted")
        .select(*part, "_carried")
    )
    found = F.coalesce("_found", "_carried")
    return null_safe_join(inside, carried, part, "left").select(
        "_row.*", *[found[n].alias(n) for n in values]
    )
