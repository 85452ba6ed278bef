"""Container attribution: cgroup text, inventories, enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe import schemas
from wattframe.functions import fixed
from wattframe.functions import scalar as S
from wattframe.operators.joins import asof_lookup, lookup_join
from wattframe.operators.rollup import PROCESS
from wattframe.operators.timeline import HOT_ROWS, with_previous


def container_ids(df: DataFrame, text: str = "cgroup_text", keys: Sequence[str] = PROCESS) -> DataFrame:
    """Short container id per process, ``''`` for host processes."""
    return df.select(*keys, S.container_id(text).alias("container_id"))


def memory_limits(df: DataFrame, text: str = "mem_limit_text", keys: Sequence[str] = PROCESS) -> DataFrame:
    """Memory limit in bytes (0 = none); unreadable text gives NULL and an error flag."""
    limit = S.memory_limit(text)
    return df.select(
        *keys,
        limit.alias("limit_bytes"),
        limit.isNull().alias("parse_error"),
    )


def parse_inventory(df: DataFrame, doc: str = "doc") -> DataFrame:
    """JSON container lists to rows: ids, first name without its slash, image, labels, pod.

    A document that cannot be read has no rows here; :func:`unreadable_inventories` lists it.
    """
    item = F.explode(F.from_json(doc, schemas.INVENTORY_DOC)).alias("c")
    name = F.regexp_replace(F.coalesce(F.get("c.Names", F.lit(0)), F.lit("")), "^/", "")
    label = lambda key: F.coalesce(F.col("c.Labels")[key], F.lit(""))
    return df.select(item).select(
        F.col("c.Id").alias("full_id"),
        F.left("c.Id", F.lit(fixed.SHORT_ID_LENGTH)).alias("short_id"),
        name.alias("name"),
        F.coalesce("c.Image", F.lit("")).alias("image_name"),
        F.col("c.Labels").alias("labels"),
        label(fixed.POD_NAME_LABEL).alias("pod_name"),
        label(fixed.POD_NAMESPACE_LABEL).alias("pod_namespace"),
    )


def unreadable_inventories(df: DataFrame, doc: str = "doc") -> DataFrame:
    """The documents that are no JSON container list, with all their columns."""
    return df.where(F.from_json(doc, schemas.INVENTORY_DOC).isNull())


def attach_container_id(
    vectors: DataFrame, ids: DataFrame, keys: Sequence[str] = PROCESS,
) -> DataFrame:
    """Adds ``container_id`` from the per-process ids, ``''`` where the process is unknown."""
    return lookup_join(vectors, ids, keys).withColumn(
        "container_id", F.coalesce("container_id", F.lit(""))
    )


#: Before any time there is.
ALWAYS = -(1 << 62)


def pid_versions(
    captures: DataFrame,
    execs: DataFrame,
    keys: Sequence[str] = PROCESS,
    time: str = "ts_us",
    text: str = "cgroup_text",
    tie: str = "event_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """From when on which container id holds for a pid: (keys, ``valid_us``, ``container_id``).

    An exec is where a pid's process begins, so what was captured before says nothing about it; the first
    capture after it does, back to the exec.  Before a pid's first mark its first capture holds.  A version
    holds until the next one; a process that is never captured has ``''``.  Of captures in one
    microsecond the last by ``tie`` counts; an exec in the same microsecond comes before them.
    """
    mark = lambda rows, rank, value: rows.select(*keys, time, F.lit(rank).alias("rank"), value.alias("id"))
    read = captures.groupBy(*keys, time).agg(F.max_by(S.container_id(text), tie).alias("id"))
    marks = mark(execs.select(*keys, time).distinct(), 0, F.lit(None).cast("string")).unionByName(
        mark(read, 1, F.col("id"))
    )
    # what follows a mark is what comes before it on the way back
    back = marks.select("*", (-F.col(time)).alias("back_us"), (-F.col("rank")).alias("back_rank"))
    seen = with_previous(
        back, keys, ["back_us", "back_rank"], {"next_rank": "rank", "next_id": "id"}, "back_us", hot_rows
    )
    own = F.when(F.col("rank") == 1, F.col("id")).when(F.col("next_rank") == 1, F.col("next_id")).otherwise("")
    first = marks.groupBy(*keys).agg(F.min_by(F.struct("rank", "id"), F.struct(time, "rank")).alias("mark"))
    versions = seen.select(*keys, F.col(time).alias("valid_us"), own.alias("id"), "rank").unionByName(
        first.where("mark.rank = 1").select(
            *keys, F.lit(ALWAYS).cast("bigint").alias("valid_us"), F.col("mark.id").alias("id"), F.lit(1).alias("rank")
        )
    )
    return versions.groupBy(*keys, "valid_us").agg(F.max_by("id", "rank").alias("container_id"))


def attach_container_id_asof(
    vectors: DataFrame,
    versions: DataFrame,
    keys: Sequence[str] = PROCESS,
    time: str = "ts_us",
    tie: Sequence[str] = ("event_id",),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds the ``container_id`` that the pid's version gives at each row's time, ``''`` without one."""
    found = asof_lookup(
        vectors,
        versions,
        key=F.struct(*keys),
        history_key=F.struct(*keys),
        values={"container_id": F.col("container_id")},
        tie=tie,
        time=time,
        history_time="valid_us",
        hot_rows=hot_rows,
    )
    return found.withColumn("container_id", F.coalesce("container_id", F.lit("")))


def lookup_key(container_id: str, keys: Sequence[str]) -> Column:
    """Host processes have no container to look up.  Giving each its own key, which no
    inventory has, keeps them from meeting in one partition under ``''``."""
    return F.coalesce(
        F.nullif(container_id, F.lit("")),
        F.concat_ws(":", F.lit("host"), *[F.col(k).cast("string") for k in keys]),
    )


def enrich(
    vectors: DataFrame,
    inventory: DataFrame,
    keys: Sequence[str] = PROCESS,
) -> DataFrame:
    """Adds the container's name, image and pod.

    A short id is always the first 12 characters of a full id, so the prefix match is an
    equi-join on the short id.  Unnamed containers do not count; of two containers with
    the same short id the smaller full id wins.
    """
    attributes = ("name", "image_name", "pod_name", "pod_namespace")
    known = (
        inventory.groupBy(F.col("short_id").alias("_lookup"))
        .agg(F.min_by(F.struct(*attributes), "full_id").alias("_found"))
        .where(F.col("_found.name") != "")
    )
    joined = lookup_join(
        vectors.withColumn("_lookup", lookup_key("container_id", keys)), known, ["_lookup"]
    )
    return joined.select(
        *vectors.columns,
        F.coalesce("_found.name", F.lit("")).alias("container_name"),
        *[F.coalesce(f"_found.{a}", F.lit("")).alias(a) for a in attributes[1:]],
    )


def enrich_asof(
    vectors: DataFrame,
    history: DataFrame,
    keys: Sequence[str] = PROCESS,
    time: str = "ts_us",
    tie: Sequence[str] = ("event_id",),
    hot_rows: int = HOT_ROWS,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Adds the name the container had in the latest inventory snapshot at that time.

    Where the vectors have no ``container_id`` yet, ``ids`` gives the processes' (and it is
    added).  Rows per container then come from rows per process, so events are counted
    without the join.
    """
    per_process = vectors.groupBy(*keys, *(() if ids is not None else ("container_id",))).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    if ids is not None:
        vectors = attach_container_id(vectors, ids, keys)
        per_process = attach_container_id(per_process, ids, keys)
    key = lookup_key("container_id", keys)
    found = asof_lookup(
        vectors,
        history,
        key=key,
        history_key=F.col("short_id"),
        values={"_name": F.col("name")},
        tie=tie,
        time=time,
        history_time="snapshot_us",
        hot_rows=hot_rows,
        fact_rows=per_process.select(key.alias("_key"), "_rows"),
    )
    return found.withColumn("container_name", F.coalesce("_name", F.lit(""))).drop("_name")
