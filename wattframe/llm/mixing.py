"""Mixing sources to target weights under a time-varying curriculum.

Each source gets a share of the word budget by its weight, at most ``most`` times its own size;
what is above is shared again by weight.  Every source also has a schedule, a weight that
changes over training time; the integral of the schedule says how much of the source's share
is due by any time, and its inverse gives each document's place in training.

Nulls: a null text has no words, a null source is a source of its own and comes last.  Empty
texts are never taken.  Equal rows are taken alike up to the one at the cut.  Texts of any length are counted
whole.  An empty table gives no rows; other columns, whatever their names, pass through ``curriculum`` and are
ignored by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.common import in_blocks, running, unused, word_count
from wattframe.session import stored

WEIGHTS = (5.0, 2.0, 1.0)
#: Weight over training time, as (time, weight) points joined by lines: heavy sources fade out
#: in the second half, light ones rise.  One schedule per weight, repeating as the weights do.
SCHEDULES = (
    ((0.0, 1.0), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (1.0, 1.5)),
)

Schedule = Sequence[tuple[float, float]]


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of a source in the order of code points, null last.

    Sources are numbered block by block; only the number of sources per block meets on the driver,
    and there are as many blocks as partitions.
    """
    spark = sources.sparkSession
    named = sources.withColumn("_last", F.col("source").isNull())
    cut = in_blocks(named, ["_last", "source"], "sources", 200_000)
    bases, total = [], 0
    for block, n in sorted((r["block"], r["count"]) for r in cut.groupBy("block").count().collect()):
        bases.append((block, total))
        total += n
    base = F.broadcast(spark.createDataFrame(bases, "block int, _base long"))
    inside = Window.partitionBy("block").orderBy("_last", "source")
    return (
        cut.join(base, "block")
        .withColumn("rank", F.col("_base") + F.row_number().over(inside) - 1)
        .drop("_last", "_base", "block", "nth")
    )


def targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Adds ``kind`` (place in ``weights``) and ``target`` to one row per (source, source_size).

    The level, words per unit of weight, starts as if no source had a cap.  Each round takes out
    the sources that it lifts above theirs and shares what they leave, until no more do: a
    few aggregates over the table of sources, one number each.
    """
    listed = F.array(*[F.lit(float(w)) for w in weights])
    size = F.col("source_size").cast("double")
    table = ranked(sources).withColumn("kind", (F.col("rank") % len(weights)).cast("int"))
    table = table.withColumn("weight", F.get(listed, F.col("kind"))).withColumn("cap", F.lit(most) * size)
    level, full = 0.0, -1
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        n, total, capped, weight = table.agg(
            F.count_if(above),
            F.sum(size),
            F.sum(F.when(above, F.col("cap"))),
            F.sum(F.when(~above, F.col("weight"))),
        ).first()
        if n == full or not weight:
            break
        full, level = n, (budget * (total or 0.0) - (capped or 0.0)) / weight
    return table.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight"))).select(
        "source", "source_size", "kind", "weight", "target"
    )


def demand(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """Per line of the schedule: start, weight at it, slope, share due before and at its end."""
    lines, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        lines.append((t0, w0, (w1 - w0) / (t1 - t0), total, total + area))
        total += area
    return [(t, w, s, a / total, b / total) for t, w, s, a, b in lines], total


def time_due(share: Column, schedule: Schedule) -> Column:
    """Training time (0 to 1) by which ``share`` of a source is due: the inverse integral."""
    lines, total = demand(schedule)
    out = None
    for t0, w0, slope, before, after in reversed(lines):
        area = (share - F.lit(before)) * F.lit(total)
        if slope:
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * area, F.lit(0.0)))
            here = F.lit(t0) + (root - F.lit(w0)) / F.lit(slope)
        else:
            here = F.lit(t0) + area / F.lit(w0)
        out = here if out is None else F.when(share <= F.lit(after), here).otherwise(out)
    return out


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Schedule] = SCHEDULES,
    budget: float = 1.5,
    most: float = 2.0,
    block_rows: int = 200_000,
) -> DataFrame:
    """One row per document: sizes, target, passes over it, words taken, training times.

    A source goes through its documents in the order of a hash of doc_id as often as its
    target holds it whole, then once more as far as the rest reaches.  ``times`` has the
    training position (0 to 1) of each pass, ``first_time`` and ``last_time`` those at its ends: the time at
    which the source's demand, its schedule integrated, reaches the middle of the document.
    """
    listed = docs.select("doc_id", word_count(F.col("text")).alias("size"), "source").withColumn(
        "place", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    )
    order = ["place", "doc_id", "size"]
    cut = in_blocks(listed, ["source", *order], "mixing", block_rows)
    sums = cut.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sums, weights, budget, most).withColumnRenamed("source", "_source")
    placed = running(cut, ["source"], order, F.col("size"), "before")
    both = placed.join(plan, placed["source"].eqNullSafe(plan["_source"]))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    more = (2 * F.col("before") + F.col("size")) < 2 * rest
    drawn = both.withColumn("whole", F.coalesce(whole, F.lit(0))).withColumn(
        "passes",
        F.when(F.col("size") > 0, F.col("whole") + F.when(more, 1).otherwise(0))
        .otherwise(0)
        .cast("int"),
    )
    drawn = drawn.withColumn("taken", F.col("size") * F.col("passes"))

    def due(nth: Column) -> Column:
        done = (nth * F.col("source_size") + F.col("before")).cast("double")
        share = F.least((done + F.col("size") / F.lit(2.0)) / F.col("target"), F.lit(1.0))
        kinds = [time_due(share, schedules[i % len(schedules)]) for i in range(len(weights))]
        out = kinds[-1]
        for i in range(len(weights) - 1):
            out = F.when(F.col("kind") == i, kinds[i]).otherwise(out)
        return out

    first, last = (F.when(F.col("passes") > 0, due(x)) for x in (F.lit(0), F.col("passes") - 1))
    passes = F.when(
        F.col("passes") > 0,
        F.transform(F.sequence(F.lit(0), F.col("passes") - 1), due),
    ).otherwise(F.array().cast("array<double>"))
    return drawn.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.col("taken").cast("long").alias("taken"),
        "passes",
        first.alias("first_time"),
        last.alias("last_time"),
        passes.alias("times"),
    )


def in_order(docs: DataFrame, **options) -> DataFrame:
    """:func:`mix`, range-sorted by the first training position; what is never taken comes last."""
    drawn = stored(mix(docs, **options), "positions")
    order = [F.asc_nulls_last("first_time"), F.asc_nulls_last("doc_id")]
    return drawn.repartitionByRange(*order).sortWithinPartitions(*order)


#: Documents up to which their places are broadcast to the texts; beyond it both are shuffled.
BROADCAST_ROWS = 1_000_000


def _null_safe(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for x, y in pairs:
        out = out & a[x].eqNullSafe(b[y])
    return out


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, block_rows: int) -> DataFrame:
    """Adds ``name``: 0, 1, ... along the order inside each key, no key in one task."""
    cut = in_blocks(rows, [*keys, *order], "numbered", block_rows)
    return running(cut, keys, order, F.lit(1), name).drop("block", "nth")


def curriculum(docs: DataFrame, block_rows: int = 200_000, **options) -> DataFrame:
    """The mixed corpus: documents repeated as often as taken, sorted by training time.

    Places are joined to the texts by doc_id, source and size.  Rows that agree in all three
    are told apart by a number, which both sides count block by block.
    """
    drawn = stored(
        mix(docs, block_rows=block_rows, **options).select("doc_id", "source", "size", "passes", "times"), "drawn"
    )
    doc, source, size, words, row, nth, times, time = unused(
        docs, "_doc", "_source", "_size", "_words", "_row", "_nth", "_times", "_time"
    )
    key = [doc, source, size]
    own = ["doc_id", "source", words]
    named = drawn.select(
        F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("size").alias(size), F.col("times").alias(times)
    )
    agreeing = named.groupBy(*key).agg(F.count("*").alias(nth), F.first(times).alias(times))
    once = agreeing.filter((F.col(nth) == 1) & (F.size(times) > 0)).drop(nth)
    if drawn.count() <= BROADCAST_ROWS:
        once = F.broadcast(once)
    texts = docs.withColumn(words, word_count(F.col("text")))
    single = texts.join(once, _null_safe(texts, once, list(zip(own, key)))).select(
        *docs.columns, F.explode(times).alias(time)
    )
    often = stored(agreeing.filter(F.col(nth) > 1).select(*key), "often")
    repeated = texts.join(often, _null_safe(texts, often, list(zip(own, key))), "left_semi")
    repeated = stored(repeated.withColumn(row, F.monotonically_increasing_id()), "repeated")
    rows = numbered(repeated.select(row, *own), own, [row], nth, block_rows)
    dealt = named.join(often, _null_safe(named, often, list(zip(key, key)))).select(named["*"])
    places = numbered(dealt, key, [times], nth, block_rows)
    met = rows.join(places, _null_safe(rows, places, [*zip(own, key), (nth, nth)])).select(row, times)
    several = repeated.join(met.filter(F.size(times) > 0), row).select(*docs.columns, F.explode(times).alias(time))
    return (
        single.unionByName(several)
        .repartitionByRange(F.col(time), F.col("doc_id"))
        .sortWithinPartitions(time, "doc_id")
        .drop(time)
    )
