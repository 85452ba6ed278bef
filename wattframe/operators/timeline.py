"""Ordered operators that do not funnel a hot key's history through one task.

A plain ``lag`` or running-sum window sorts all rows of a key in one task, so one busy CPU
or process decides the run time.  Here the rows per key are counted first (a narrow,
map-side-combined aggregate).  Keys with few rows are windowed as they are.  A hot key is
cut into stretches of time that hold about equally many rows, at quantiles of its times:

1. the window runs inside (key, stretch), which spreads the key over the cluster;
2. each stretch of a hot key is reduced to one small row by an aggregate, and the state
   handed from one stretch to the next comes from a window over those rows;
3. that state is joined back on (key, stretch), the partitioning step 1 already has.

Counting is a pass over the key column alone, made when the operator is called.  Without hot keys what it
returns is one plain window, so the source is read twice in all, and an operator on top of another adds one
pass.  With them the source is read again for those keys, key, order and value columns only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.functions.scalar import MICROS, bucket_start, position
from wattframe.session import stored

HOT_ROWS = 2_000_000
#: Keys that can be hot at once: beyond ``HOT_ROWS``, a key is hot only if it has more than
#: this share of all rows.  Bounds what is broadcast to about 3 MB, whatever the table.
MOST_HOT = 50_000
#: Quantiles a hot key is cut at, at most; a power of two.
PIECES = 4096
FIRST_STRETCH = -(1 << 62)
DEFAULT_BUCKET = 60 * MICROS
STRETCH = "_stretch"


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which NULL keys are equal; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    same = F.lit(True)
    for k in on:
        same = same & left[k].eqNullSafe(renamed[f"_right_{k}"])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in on])


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the times, ``_cuts``, they are cut at.

    A stretch holds half of ``hot_rows`` rows, within the error of the quantiles, however
    densely the rows lie; only rows of one and the same microsecond stay together.  Of a table
    with more than ``MOST_HOT`` times ``hot_rows`` rows, keys with less than that share are
    not called hot, so there are never more of them.  ``counts`` are the keys' ``_rows`` where
    the caller knows them from something narrower than ``df``.
    """
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    limit = F.greatest(
        F.lit(float(hot_rows)),
        F.coalesce(counts.agg(F.sum("_rows") / F.lit(float(MOST_HOT))).scalar(), F.lit(0.0)),
    )
    busy = counts.withColumn("_limit", limit).where(F.col("_rows") > F.col("_limit"))
    rows = null_safe_join(df.select(*keys, time), F.broadcast(busy), keys, "inner")
    quantiles = F.percentile_approx(time, [i / PIECES for i in range(1, PIECES)], 4 * PIECES)
    cut = rows.groupBy(*keys).agg(
        quantiles.alias("_all"), F.max("_rows").alias("_rows"), F.max("_limit").alias("_limit")
    )
    every = F.greatest(
        F.floor(F.col("_limit") * PIECES / (2 * F.col("_rows"))).cast("int"), F.lit(1)
    )
    chosen = F.filter("_all", lambda t, i: (i + 1) % F.col("_every") == 0)
    return cut.withColumn("_every", every).select(
        *keys, F.array_distinct(F.transform(chosen, lambda t: t.cast("bigint"))).alias("_cuts")
    )


def known_hot(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame | None:
    """:func:`hot_keys` as a small table of its own, or None if one narrow pass finds no hot key."""
    if not keys:  # a single timeline, which is cut where it is used
        return hot_keys(df, keys, time, hot_rows, counts)
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if counts.where(F.col("_rows") > hot_rows).isEmpty():
        return None
    return stored(hot_keys(df, keys, time, hot_rows, counts), "hot-keys")


def _stretch_of(time: Column, cuts: Column) -> Column:
    """The last cut that is not after ``time``, by bisection."""
    steps = F.array(*[F.lit(PIECES >> k) for k in range(1, PIECES.bit_length())])
    place = F.aggregate(
        steps,
        F.lit(-1),
        lambda at, step: F.when(F.get(cuts, at + step) <= time, at + step).otherwise(at),
    )
    return F.coalesce(F.get(cuts, place), F.lit(FIRST_STRETCH))


def with_stretch(
    df: DataFrame, keys: Sequence[str], time: str, hot: DataFrame, only_hot: bool = False
) -> DataFrame:
    """Adds the start of the row's stretch; keys that are not hot have a single one.

    ``hot`` is broadcast, its size is bounded by construction (see :func:`hot_keys`).
    """
    marked = null_safe_join(df, F.broadcast(hot), keys, "inner" if only_hot else "left")
    start = F.when(F.col("_cuts").isNull(), F.lit(0).cast("bigint")).otherwise(
        _stretch_of(F.col(time), F.col("_cuts"))
    )
    return marked.select(*df.columns, start.alias(STRETCH))


def _rows_so_far(part: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _stretches_before(keys: Sequence[str]):
    return (
        Window.partitionBy(*keys).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
    time: str = "ts_us",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds ``{new name: source column}`` taken from the key's previous row (NULL if none)."""
    part = [*keys, STRETCH]
    hot = known_hot(df, keys, time, hot_rows)
    if hot is None:
        per_key = Window.partitionBy(*keys).orderBy(*order)
        return df.select(*df.columns, *[F.lag(source).over(per_key).alias(n) for n, source in values.items()])
    in_stretch = Window.partitionBy(*part).orderBy(*order)
    inside = with_stretch(df, keys, time, hot).withColumns(
        {
            "_nth": F.row_number().over(in_stretch),
            **{f"_inside_{n}": F.lag(source).over(in_stretch) for n, source in values.items()},
        }
    )
    place = position(order)
    ends = (
        with_stretch(df, keys, time, hot, only_hot=True)
        .groupBy(*part)
        .agg(*[F.max_by(source, place).alias(f"_end_{n}") for n, source in values.items()])
    )
    per_key = Window.partitionBy(*keys).orderBy(STRETCH)
    carried = ends.select(
        *part, *[F.lag(f"_end_{n}").over(per_key).alias(f"_carried_{n}") for n in values]
    )
    opens = F.col("_nth") == 1
    return null_safe_join(inside, carried, part, "left").select(
        *df.columns,
        *[
            F.when(opens, F.col(f"_carried_{n}")).otherwise(F.col(f"_inside_{n}")).alias(n)
            for n in values
        ],
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    sums: Mapping[str, Column],
    time: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Running sums per key at each distinct ``at``; ``time`` is ``at`` in microseconds.

    The rows are shuffled once, by (key, stretch): adding up equal times and the running sum
    both work on that partitioning.
    """
    part = [*keys, STRETCH]
    rows = df.select(*keys, at, time, *[v.alias(f"_in_{n}") for n, v in sums.items()])
    hot = known_hot(rows, keys, time, hot_rows)
    add_up = [F.sum(f"_in_{n}").alias(f"_in_{n}") for n in sums]
    if hot is None:
        points = rows.repartition(*keys).groupBy(*keys, at).agg(*add_up)
        so_far = _rows_so_far(keys, [at])
        return points.select(*keys, at, *[F.sum(f"_in_{n}").over(so_far).alias(n) for n in sums])
    points = (
        with_stretch(rows, keys, time, hot).repartition(*part).groupBy(*part, at).agg(*add_up)
    )
    so_far = _rows_so_far(part, [at])
    inside = points.select(
        *part, at, *[F.sum(f"_in_{n}").over(so_far).alias(f"_at_{n}") for n in sums]
    )
    before = _stretches_before(keys)
    carried = (
        with_stretch(rows, keys, time, hot, only_hot=True)
        .groupBy(*part)
        .agg(*add_up)
        .select(*part, *[F.sum(f"_in_{n}").over(before).alias(f"_from_{n}") for n in sums])
    )
    zero = F.lit(0)
    return null_safe_join(inside, carried, part, "left").select(
        *keys,
        at,
        *[(F.col(f"_at_{n}") + F.coalesce(f"_from_{n}", zero)).alias(n) for n in sums],
    )


def running_since(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    reset: Column,
    name: str,
    time: str = "ts_us",
    hot_rows: int = HOT_ROWS,
    previous: str | None = None,
) -> DataFrame:
    """Running sum per key that starts again at each reset row (the row itself included).

    ``previous`` names a second column, the sum at the key's row before (NULL if none); it
    comes from the same window.
    """
    hot = known_hot(df, keys, time, hot_rows)
    part = [*keys, *(() if hot is None else (STRETCH,))]
    so_far = _rows_so_far(part, order)

    def since_reset(rows: DataFrame, prior: bool = False) -> DataFrame:
        before_row = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        running = {"_sum": F.sum("_value").over(so_far)}
        if prior:
            running["_nth"] = F.count(F.lit(1)).over(so_far)
        summed = rows.withColumns({"_value": value, "_reset": reset}).withColumns(running)
        at_reset = F.when(F.col("_reset"), F.col("_sum") - F.col("_value"))
        base = {"_base": F.last(at_reset, ignorenulls=True).over(so_far)}
        if prior:
            base["_prior_base"] = F.last(at_reset, ignorenulls=True).over(before_row)
        return summed.withColumns(base).withColumn(
            "_since", F.col("_sum") - F.coalesce("_base", F.lit(0))
        )

    if hot is None:
        whole = since_reset(df, previous is not None)
        prior_sum = F.col("_sum") - F.coalesce("_value", F.lit(0)) - F.coalesce("_prior_base", F.lit(0))
        first = [] if previous is None else [F.when(F.col("_nth") > 1, prior_sum).alias(previous)]
        return whole.select(*df.columns, F.col("_since").alias(name), *first)
    inside = since_reset(with_stretch(df, keys, time, hot), previous is not None)
    ends = (
        since_reset(with_stretch(df, keys, time, hot, only_hot=True))
        .groupBy(*part)
        .agg(
            F.max_by("_since", position(order)).alias("_end"),
            F.max("_reset").alias("_had_reset"),
        )
    )
    up_to = _rows_so_far(keys, [STRETCH])
    total = ends.withColumn("_total", F.sum("_end").over(up_to))
    at_reset = F.when(F.col("_had_reset"), F.col("_total") - F.col("_end"))
    base = F.last(at_reset, ignorenulls=True).over(up_to)
    state = total.withColumn("_state", F.col("_total") - F.coalesce(base, F.lit(0)))
    carried = state.select(
        *part, F.lag("_state").over(Window.partitionBy(*keys).orderBy(STRETCH)).alias("_from")
    )
    carry = lambda started: F.when(started, F.lit(0)).otherwise(F.coalesce("_from", F.lit(0)))
    added = [(F.col("_since") + carry(F.col("_base").isNotNull())).alias(name)]
    if previous is not None:
        prior_sum = F.col("_sum") - F.coalesce("_value", F.lit(0)) - F.coalesce("_prior_base", F.lit(0))
        added.append(
            F.when(F.col("_nth") == 1, F.col("_from"))
            .otherwise(prior_sum + carry(F.col("_prior_base").isNotNull()))
            .alias(previous)
        )
    return null_safe_join(inside, carried, part, "left").select(*df.columns, *added)


def sliding_sum(
    df: DataFrame,
    keys: Sequence[str],
    window_us: int,
    sums: Mapping[str, Column],
    time: str = "ts_us",
    bucket_us: int = DEFAULT_BUCKET,
) -> DataFrame:
    """Per row, the exact sum (integers or decimals) over the key's rows in
    ``(time - window, time]``.

    A moving frame is added up anew for every row, which is quadratic where rows are dense.
    Instead each value enters at its time and leaves one window later, and a running sum
    over entries and exits is the sum inside the window.

    Time is cut into buckets at least two windows wide, so a value can only matter to its
    own bucket and the next one, and one pass is enough.  Only the entry in the own bucket
    carries the row's columns.  Callers reduce rows to one per key and step first, which
    bounds what a bucket can hold, however many events there are.
    """
    width = max(int(bucket_us), 2 * int(window_us))
    at = F.col(time)
    home = bucket_start(at, width)
    following = home + F.lit(width)
    leaves = at + F.lit(int(window_us))
    move = lambda bucket, when, sign: F.struct(
        bucket.alias("bucket"), when.alias("at"), F.lit(sign).alias("sign")
    )
    elsewhere = (
        F.when(leaves < following, F.array(move(home, leaves, -1)))
        .when(leaves > following, F.array(move(following, at, 1), move(following, leaves, -1)))
        .otherwise(F.array())
    )
    moves = F.concat(F.array(move(home, at, 0)), elsewhere)
    staged = df.select("*", *[v.alias(f"_in_{n}") for n, v in sums.items()]).select(
        "*", F.explode(moves).alias("_move")
    )
    own = F.col("_move.sign") == 0  # marks the entry that stands for the row itself
    signed = staged.select(
        *keys,
        F.col("_move.bucket").alias("_bucket"),
        F.col("_move.at").alias("_at"),
        F.when(own, F.struct(*df.columns)).alias("_row"),
        *[
            F.when(F.col("_move.sign") < 0, -F.col(f"_in_{n}"))
            .otherwise(F.col(f"_in_{n}"))
            .alias(f"_in_{n}")
            for n in sums
        ],
    )
    so_far = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy("_at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        signed.select("_row", *[F.sum(f"_in_{n}").over(so_far).alias(n) for n in sums])
        .where(F.col("_row").isNotNull())
        .select("_row.*", *sums)
    )
