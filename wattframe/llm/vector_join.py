"""Near-duplicate vectors by an epsilon grid order join.

Vectors of unit length are projected on their leading principal directions, put in the order
of the grid cells they fall in, and cut into sequence intervals.  Two vectors with a cosine of
``least`` or more are at most epsilon = sqrt(2 - 2 least) apart, and projecting moves no pair
further apart, so two intervals whose projected boxes are further apart than that share no
pair.  The other pairs of intervals are joined recursively: halves are skipped the same way,
and what is left is compared by cosine in double precision.

Neighbouring intervals form groups, and a task takes all pairs of intervals of two groups: an interval moves
once per partner group instead of once per partner.  Groups grow with the table, as far as a task's memory goes,
as long as there are pairs of groups enough for all tasks.

Equal vectors are one class, compared once.  A vector that is null, empty, zero or holds null,
NaN or infinite components links with nothing, and vectors of different length never link.
Rows that repeat are other vectors to each other.  An empty table gives no rows; columns other
than the id and the vector are ignored.

The principal directions come from a bounded sample (``SAMPLE``, the first by a hash of the
vector); they only decide the order, never a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.graph import Union, components
from wattframe.session import stored

SAMPLE = 4096
#: Principal directions used for boxes, and how many of them make up the grid key of an interval.
LEADING, KEYED = 8, 3
#: Bytes of vectors in an interval, vectors in a leaf of the recursion.
INTERVAL_BYTES, LEAF = 1 << 20, 512
#: Intervals per range partition, about, and most intervals in a group; powers of two.
PER_PARTITION, GROUPED = 8, 16
SLACK = 1e-9


def classes(vectors: DataFrame, vec_id: str, column: str) -> DataFrame:
    """(vec_id, node, data): a class per distinct usable vector, its bytes as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().cast(pa.float64())
            flat = values.to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            node, data = [], []
            for size, end in zip(sizes, ends):
                v = flat[end - size : end]
                good = size and np.isfinite(v).all() and np.abs(v).max() > 0
                raw = v.tobytes() if good else None
                data.append(raw)
                digest = hashlib.blake2b(raw, digest_size=8).digest() if raw else None
                node.append(int.from_bytes(digest, "little", signed=True) if raw else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(node, pa.int64()), pa.array(data, pa.binary())],
                ["vec_id", "node", "data"],
            )

    return vectors.select(F.col(vec_id).cast("long"), column).mapInArrow(
        run, "vec_id long, node long, data binary"
    )


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows of unit length; shorter vectors are filled up with zeros."""
    width = max(len(x) for x in raw) // 8
    out = np.zeros((len(raw), width))
    for i, x in enumerate(raw):
        v = np.frombuffer(x)
        v = v / np.abs(v).max()
        out[i, : len(v)] = v / np.sqrt(v @ v)
    return out


def directions(reps: DataFrame) -> np.ndarray:
    """Orthonormal columns: the leading principal directions of a bounded sample."""
    raw = [r[0] for r in reps.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("data").collect()]
    if not raw:
        return np.zeros((0, 0))
    x = unit(raw)
    x = x - x.mean(0)
    _, axes = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(axes[:, ::-1][:, :LEADING])


def project(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the directions; both are cut to the narrower width."""
    width = min(x.shape[1], len(axes))
    return x[:, :width] @ axes[:width]


def gap(a_low, a_high, b_low, b_high) -> float:
    """Least squared distance between two boxes."""
    apart = np.maximum(np.maximum(a_low - b_high, b_low - a_high), 0)
    return float(apart @ apart)


def join(a, b, same: bool, least: float, hit) -> None:
    """Calls ``hit(i, j, mask)`` for the leaves of two intervals (vectors, coordinates, length)."""
    bound = 2 - 2 * least + SLACK

    def go(a0, a1, b0, b1):
        if same and b1 <= a0:
            return
        low_a, low_b = a[1][a0:a1], b[1][b0:b1]
        if gap(low_a.min(0), low_a.max(0), low_b.min(0), low_b.max(0)) > bound:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            near = a[0][a0:a1] @ b[0][b0:b1].T >= least
            if not (a[2][0] == b[2]).all() or not (a[2] == a[2][0]).all():
                near &= a[2][a0:a1, None] == b[2][None, b0:b1]
            if same:
                near &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
            if near.any():
                hit(a0, b0, near)
            return
        if a1 - a0 >= b1 - b0:
            middle = (a0 + a1) // 2
            go(a0, middle, b0, b1)
            go(middle, a1, b0, b1)
        else:
            middle = (b0 + b1) // 2
            go(a0, a1, b0, middle)
            go(a0, a1, middle, b1)

    go(0, len(a[0]), 0, len(b[0]))


def joined(a: dict, b: dict, same: bool, least: float) -> pd.DataFrame:
    """Of a pair of intervals: (node, links) per vector with links and (node, root) per edge."""
    nodes = np.concatenate([a["node"], b["node"]]) if not same else a["node"]
    copies = np.concatenate([a["copies"], b["copies"]]) if not same else a["copies"]
    links, union = np.zeros(len(nodes), np.int64), Union(len(nodes))
    shift = 0 if same else len(a["node"])

    def hit(i, j, near):
        rows, cols = near.shape
        left, right = slice(i, i + rows), slice(shift + j, shift + j + cols)
        links[left] += near @ copies[right]
        links[right] += copies[left] @ near
        # labels spread inside the leaf; each vector is then linked with its label once
        up, down = np.arange(rows), np.full(cols, rows)
        while True:
            new_down = np.where(near, up[:, None], rows).min(0)
            new_up = np.minimum(up, np.where(near, new_down[None, :], rows).min(1))
            if (new_up == up).all() and (new_down == down).all():
                break
            up, down = new_up, new_down
        for r in np.flatnonzero(up != np.arange(rows)):
            union.link(i + int(up[r]), i + int(r))
        for c in np.flatnonzero(down < rows):
            union.link(i + int(down[c]), shift + j + int(c))

    join((a["x"], a["y"], a["size"]), (b["x"], b["y"], b["size"]), same, least, hit)
    at, root = union.forest()
    some = np.flatnonzero(links)
    return pd.DataFrame(
        {
            "node": np.concatenate([nodes[some], nodes[at]]),
            "links": np.concatenate([links[some], np.zeros(len(at), np.int64)]),
            "root": np.concatenate([nodes[some], nodes[root]]),
        }
    )


def intervals(reps: DataFrame, axes: np.ndarray, epsilon: float) -> DataFrame:
    """One row per sequence interval: its classes in grid order, its box and its grid cells."""
    spark = reps.sparkSession
    shared = spark.sparkContext.broadcast(axes)
    keys = [f"c{i}" for i in range(min(LEADING, axes.shape[1]))]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column("data").to_pylist())
            cells = np.floor(project(x, shared.value) / epsilon).astype(np.int32)
            columns = [pa.array(np.ascontiguousarray(cells[:, i])) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays(batch.columns + columns, batch.schema.names + keys)

    schema = "node long, copies long, data binary, " + ", ".join(f"{k} int" for k in keys)
    cells = reps.select("node", "copies", "data").mapInArrow(placed, schema)
    total = reps.agg(F.coalesce(F.sum(F.length("data")), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-total[0] // (PER_PARTITION * INTERVAL_BYTES)))
    ordered = cells.repartitionByRange(parts, *keys, "node").sortWithinPartitions(*keys, "node")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and size + len(row["data"]) > INTERVAL_BYTES:
                    yield whole(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["data"])
        if held:
            yield whole(held)

    def whole(rows: list[dict]) -> pa.RecordBatch:
        coordinates = project(unit([r["data"] for r in rows]), shared.value)
        own = sorted({tuple(r[k] for k in keys[:KEYED]) for r in rows})
        return pa.RecordBatch.from_pylist(
            [
                {
                    "block": rows[0]["node"],
                    "nodes": [r["node"] for r in rows],
                    "copies": [r["copies"] for r in rows],
                    "sizes": [len(r["data"]) // 8 for r in rows],
                    "data": b"".join(r["data"] for r in rows),
                    "low": coordinates.min(0).tolist(),
                    "high": coordinates.max(0).tolist(),
                    "cells": [list(c) for c in own],
                }
            ],
            block_schema,
        )

    block_schema = pa.schema(
        [
            ("block", pa.int64()), ("nodes", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())),
            ("sizes", pa.list_(pa.int32())), ("data", pa.binary()), ("low", pa.list_(pa.float64())),
            ("high", pa.list_(pa.float64())), ("cells", pa.list_(pa.list_(pa.int32()))),
        ]
    )
    ddl = (
        "block long, nodes array<long>, copies array<long>, sizes array<int>, data binary, "
        "low array<double>, high array<double>, cells array<array<int>>"
    )
    # the number of the partition, and of the interval in it: grid order
    place = F.monotonically_increasing_id()
    return ordered.mapInArrow(cut, ddl).withColumn("part", F.shiftright(place, 33)).withColumn(
        "nth", place.bitwiseAND((1 << 33) - 1)
    )


def grouped(blocks: DataFrame, tasks: int) -> DataFrame:
    """Adds ``group``: the intervals of a group are neighbours in grid order, as many as leave at least ``tasks``
    pairs of groups, and no more than a task holds."""
    most = blocks.count() / max(1.0, 2 * np.sqrt(tasks))
    size = 1
    while 2 * size <= min(most, GROUPED):
        size *= 2
    inside = min(size, PER_PARTITION)
    parts = max(1, size // PER_PARTITION)
    # a partition may hold more intervals than planned; those beyond are groups of their own
    return blocks.withColumn("group", F.floor(F.col("part") / parts) * F.lit(1 << 32) + F.floor(F.col("nth") / inside))


def near_blocks(blocks: DataFrame, epsilon: float, keyed: int) -> DataFrame:
    """Pairs (a, b), a <= b, of intervals that may share a pair of near vectors, with their groups.

    Intervals meet on a grid cell of the first directions, one of them with the cells next to
    its own; what meets is then held against the distance of the boxes.  Only numbers of
    intervals and boxes move here, not vectors.
    """
    boxes = blocks.select("block", "group", "low", "high", F.explode("cells").alias("cell"))
    around = boxes
    for i in range(keyed):
        near = F.sequence(F.col("cell")[i] - 1, F.col("cell")[i] + 1)
        around = around.select("*", F.explode(near).alias(f"k{i}"))
    around = around.select("block", "group", "low", "high", F.array(*[f"k{i}" for i in range(keyed)]).alias("cell"))
    side = lambda rows, s: rows.select(
        F.col("block").alias(s), F.col("group").alias(f"{s}g"), F.col("low").alias(f"{s}l"), F.col("high").alias(f"{s}h"), "cell"
    )
    left, right = side(boxes, "a"), side(around.distinct(), "b")
    apart = F.zip_with(
        F.zip_with("al", "bh", lambda x, y: x - y),
        F.zip_with("bl", "ah", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    distance = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)
    met = left.join(right, "cell").filter((F.col("a") <= F.col("b")) & (distance <= epsilon * epsilon + SLACK))
    return met.select("a", "b", F.least("ag", "bg").alias("g1"), F.greatest("ag", "bg").alias("g2")).distinct()


def links(blocks: DataFrame, pairs: DataFrame, axes: np.ndarray, least: float) -> DataFrame:
    """(node, links, root) of all near pairs.  A task holds the intervals of two groups, and of the next two
    only once it is done with them."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(axes)
    part, key = ["nodes", "copies", "sizes", "data"], ["g1", "g2"]
    pairs = stored(pairs, "pairs")
    needed = pairs.select(*key, F.explode(F.array("a", "b")).alias("block")).distinct()
    held = needed.join(blocks.select("block", *part), "block").select(*key, F.lit(0).alias("kind"), "block", *part)
    asked = pairs.select(*key, F.lit(1).alias("kind"), F.col("a").alias("block"), F.col("b").alias("other"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = held.unionByName(asked, allowMissingColumns=True).repartition(4 * tasks, *key)
    rows = rows.select(*key, "kind", "block", *part, "other").sortWithinPartitions(*key, "kind", "block", "other")

    def opened(block: dict) -> dict:
        sizes = np.array(block["sizes"])
        ends = np.cumsum(sizes) * 8
        raw = [block["data"][e - s * 8 : e] for s, e in zip(sizes, ends)]
        x = unit(raw)
        return {
            "node": np.array(block["nodes"], np.int64), "copies": np.array(block["copies"], np.int64),
            "size": sizes, "x": x, "y": project(x, shared.value),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                if (one["g1"], one["g2"]) != now:
                    now, group = (one["g1"], one["g2"]), {}
                if one["kind"] == 0:
                    group[one["block"]] = opened(one)
                    continue
                same = one["block"] == one["other"]
                a, b = dict(group[one["block"]]), dict(group[one["other"]])
                width = max(a["x"].shape[1], b["x"].shape[1])
                for side in (a, b):
                    if side["x"].shape[1] < width:
                        side["x"] = np.pad(side["x"], ((0, 0), (0, width - side["x"].shape[1])))
                out = joined(a, b, same, least)
                if len(out):
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return rows.mapInArrow(run, "node long, links long, root long")


def near_duplicates(
    vectors: DataFrame, least: float = 0.9, vec_id: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """One row per vector: number of links, component and whether it stays."""
    epsilon = float(np.sqrt(2 - 2 * least))
    known = stored(classes(vectors, vec_id, column), "vectors")
    usable = known.filter("node is not null")
    reps = usable.groupBy("node").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.first("data").alias("data")
    )
    reps = stored(reps, "classes")
    axes = directions(reps)
    if not axes.size:
        alone = known.select("vec_id", F.lit(0).cast("long").alias("n_links"))
        return alone.select("*", F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = grouped(stored(intervals(reps, axes, epsilon), "intervals"), tasks)
    found = stored(links(blocks, near_blocks(blocks, epsilon, min(KEYED, axes.shape[1])), axes, least), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(edges)
    own = (
        reps.select("node", "copies", "first_id")
        .join(counts, "node", "left")
        .join(roots.withColumnRenamed("id", "node"), "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    smallest = own.groupBy("root").agg(F.min("first_id").alias("component_id"))
    own = own.join(smallest, "root").select(
        "node",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "component_id",
    )
    # rows without a class keep a key each, so that they do not meet in one task
    linked = usable.select("vec_id", "node").join(own, "node").select("vec_id", "n_links", "component_id")
    alone = known.filter("node is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
