"""Column expressions.  Everything here is a built-in Spark expression."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattframe.functions import fixed

MICROS = 1_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch (session time zone must be UTC for NTZ input)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def bucket_start(time_us: Column | str, width_us: int) -> Column:
    """Start of the fixed-width time bucket a microsecond time falls into."""
    t = col(time_us)
    return t - F.pmod(t, F.lit(int(width_us)).cast("bigint"))


def position(order) -> Column:
    """Order columns as one value that can be compared.

    One column is used as it is.  A (time, id) pair of non-negative integers becomes a
    decimal: unlike a struct, min/max/max_by over it runs as a hash aggregate, so map tasks
    need not sort their rows first.
    """
    first = col(order[0])
    if len(order) == 1:
        return first
    if len(order) == 2:
        shifted = first.cast("decimal(18,0)") * F.lit(Decimal(10**19))
        return (shifted + col(order[1]).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.struct(*order)


def nul_cut(text: Column | str) -> Column:
    """Text up to the first NUL."""
    return F.substring_index(col(text), "\0", 1)


def pid_of(packed: Column | str) -> Column:
    return col(packed).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def tgid_of(packed: Column | str) -> Column:
    return F.shiftrightunsigned(col(packed), 32)


def is_fault(kind: Column | str) -> Column:
    return col(kind).isin("fault_user", "fault_kernel")


def is_major_fault(kind: Column | str, error_code: Column | str) -> Column:
    """Kernel faults are always major, user faults when bit 0 of the error code is set."""
    kind = col(kind)
    user = (kind == "fault_user") & (col(error_code).bitwiseAND(F.lit(1).cast("bigint")) != 0)
    return (kind == "fault_kernel") | user


def is_involuntary(prev_state: Column | str) -> Column:
    """A task that was still runnable was preempted."""
    return col(prev_state) == 0


def container_id(cgroup_text: Column | str) -> Column:
    """Container id (12 characters) from ``hierarchy:controllers:path`` lines, ``''`` if none.

    The first line with a hit wins; within a line the patterns are tried in order.
    Stays inside the row: no explode, so no shuffle to bring the lines back together.
    """
    lines = F.split(col(cgroup_text), "\n")
    paths = F.transform(
        lines,
        lambda line: F.regexp_extract(F.btrim(line, F.lit(" \t\r")), r"^[^:]*:[^:]*:(.*)$", 1),
    )
    ids = F.transform(
        F.filter(paths, lambda p: (p != "") & (p != "/")),
        lambda p: F.coalesce(
            *[
                F.nullif(F.regexp_extract(p, pattern, 1), F.lit(""))
                for pattern in fixed.CONTAINER_ID_PATTERNS
            ],
            F.lit(""),
        ),
    )
    first = F.get(F.filter(ids, lambda i: i != ""), F.lit(0))
    return F.coalesce(F.left(first, F.lit(fixed.SHORT_ID_LENGTH)), F.lit(""))


def memory_limit(text: Column | str) -> Column:
    """Bytes; 0 means unlimited, NULL means the text does not begin with an unsigned number.

    What follows the digits is not looked at; a number of more than 64 bits is an error.
    """
    trimmed = F.btrim(col(text), F.lit(" \t\r\n"))
    digits = F.regexp_extract(trimmed, "^([0-9]+)", 1).try_cast("decimal(38,0)")
    number = F.when(digits < F.lit(str(2**64)).cast("decimal(38,0)"), digits).cast("decimal(20,0)")
    return F.when(trimmed.isin(*fixed.NO_MEMORY_LIMIT), F.lit(0).cast("decimal(20,0)")).otherwise(number)


def is_ai(comm: Column | str) -> Column:
    return col(comm).isin(*fixed.AI_COMMS)


def nonempty(text: Column | str, *defaults: Column | str) -> Column:
    """``text`` unless it is empty, else the first default."""
    return F.coalesce(F.nullif(col(text), F.lit("")), *[
        d if isinstance(d, Column) else F.lit(d) for d in defaults
    ])


def joules(nanojoules: Column | str) -> Column:
    return col(nanojoules).cast("double") / F.lit(fixed.NJ_PER_JOULE)


def carbon_grams(energy_joules: Column | str, intensity: Column | float) -> Column:
    intensity = intensity if isinstance(intensity, Column) else F.lit(float(intensity))
    return col(energy_joules) / F.lit(fixed.JOULES_PER_KWH) * intensity


def to_nanojoules(energy_joules: Column | str) -> Column:
    return F.floor(col(energy_joules) * F.lit(fixed.NJ_PER_JOULE) + F.lit(0.5)).cast("bigint")


def fixed3(nanojoules: Column | str) -> Column:
    """Joules to three decimals, rounded half up on the whole nanojoules."""
    milli = F.floor((col(nanojoules) + F.lit(500_000)) / F.lit(1_000_000)).cast("double")
    return milli / F.lit(1000.0)


def milligrams(grams: Column | str) -> Column:
    return col(grams) * F.lit(1000.0)


def clock(ts: Column | str) -> Column:
    """``HH:mm`` axis label."""
    return F.date_format(col(ts), "HH:mm")


def band(value: Column | str, panel: str) -> Column:
    """Colour of the highest threshold step at or below the value."""
    base, steps = fixed.THRESHOLDS[panel]
    out = F.lit(base)
    for bound, colour in steps:
        out = F.when(col(value) >= F.lit(bound), F.lit(colour)).otherwise(out)
    return out


def is_finite(c: Column | str) -> Column:
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def add(columns) -> Column:
    """Left-to-right sum, so both engines add doubles in the same order."""
    return reduce(lambda a, b: a + b, columns)
