"""What several corpus operators share: words, lambda-bound values, blocks of an order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattframe.session import stored

#: White space between words: space and the control characters 9 to 13.
BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, computed once: a lambda's variable is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """All words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def unused(rows: DataFrame, *names: str) -> list[str]:
    """``names``, each made longer until ``rows`` has no such column."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def in_blocks(rows: DataFrame, order: list[str], name: str, block_rows: int) -> DataFrame:
    """``rows`` range-partitioned by ``order`` and written, with their ``block`` and a number ``nth``.

    Blocks follow the order, so a running value needs one row per block besides a window that
    stays inside a block.  The rows are written first: the cut samples the table, not what made it, and
    each row gets a number, which comes last in the order, so that equal rows part too.  The blocks are
    written because the cut comes from a sample: later reads agree.
    """
    spark = rows.sparkSession
    listed = stored(rows.withColumn("nth", F.monotonically_increasing_id()), f"{name}-rows")
    n = max(1, -(-listed.count() // block_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = listed.repartitionByRange(n, *order, "nth").withColumn("block", F.spark_partition_id())
    return stored(cut, name)


def running(
    rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the key's rows before this one.

    ``rows`` come from ``in_blocks`` by the keys and then the order.  No key is sorted whole:
    the window runs inside (key, block), and one row per key and block carries the sums on.
    Rows that are equal by the order follow in that of their numbers.
    """
    part = rows.groupBy(*keys, "block").agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_base", F.coalesce(F.sum("_part").over(before), F.lit(0))).drop("_part")
    part = part.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "block"])], "_base")
    inside = Window.partitionBy(*keys, "block").orderBy(*order, "nth").rowsBetween(
        Window.unboundedPreceding, -1
    )
    own = rows.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [own[k].eqNullSafe(part[f"_k{i}"]) for i, k in enumerate([*keys, "block"])]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return own.join(part, on).withColumn(name, F.col("_own") + F.col("_base")).drop(
        "_own", "_base", *[f"_k{i}" for i in range(len(same))]
    )
