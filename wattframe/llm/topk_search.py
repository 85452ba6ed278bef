"""Exact top-k by inner product, with multi-resolution segment statistics.

A vector is cut into segments; with means m and deviations s of a segment of length n, two vectors
are at least sqrt(n ((m - m')^2 + (s - s')^2)) apart there.  With both norms known, a lower bound of
the distance is an upper bound of the inner product: the sum of n (m m' + s s').  It is taken
from one segment to ever more, and only what may still reach a query's k-th score gets its
exact product in whole numbers.

Rows with equal vectors are one class that holds its k + 1 smallest ids: more of them can be in no
answer, the query's own row left out.  Classes are sorted by a coarse sketch of their statistics into blocks.
Ranges of the statistics per block bound whole blocks: a query first goes to its most promising
block, whose k-th score then rules out other blocks, and only to those that are left.
A task holds the queries of one cell (block and chunk of queries) and reads the block past them.

Nulls: a null vector, or one with a null, NaN or infinite component, takes no part.  A null id is no
query and comes after all other ids of its score.  Empty vectors take part with each other, score 0;
vectors only meet others of their length.  Rows that repeat are candidates each, and a query row
leaves out one row of its id and vector.  An empty table gives no rows; other columns are ignored.
Components are taken to fit 64 bits after scaling; a product beyond them, also of a query with itself,
is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattframe.session import stored

K, EVERY, SCALE = 5, 50, 256.0
#: Segments per vector at each resolution.
LEVELS = (1, 4, 16)
#: Classes in a block, unless there would be too many blocks; their ranges are on the driver.
BLOCK_ROWS, MOST_BLOCKS = 16_384, 8_192
#: Queries in a cell.
CHUNK = 32_768
#: Queries and candidates compared at once, and pairs whose product is taken at once.
TILE, PAIRS = (512, 2048), 50_000

ANSWERS = pa.schema(
    [("v", pa.list_(pa.int64())), ("score", pa.int64()), ("vec_id", pa.int64())]
)
ANSWERS_DDL = "v array<long>, score long, vec_id long"


def whole(embeddings: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, v): usable vectors in whole numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    usable = embeddings.filter(F.col("embedding").isNotNull() & F.forall("embedding", finite))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): each different vector with its ``keep`` smallest ids, null ones last."""
    by_id = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"))
    first = rows.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= keep)
    listed = F.sort_array(F.collect_list(F.struct("nth", "vec_id")))
    return first.groupBy("v").agg(F.transform(listed, lambda r: r["vec_id"]).alias("ids"))


def cuts(size: int, segments: int) -> np.ndarray:
    """Where the segments begin; no more segments than components."""
    return (np.arange(min(segments, size)) * size) // max(min(segments, size), 1)


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations per segment, each times the root of the segment's length.

    The inner product of two such rows bounds that of the vectors from above.
    """
    v = v.astype(np.float64)
    n, size = v.shape
    if not size:
        return np.zeros((n, 2))
    at = cuts(size, segments)
    length = np.diff(np.append(at, size)).astype(np.float64)
    mean = np.add.reduceat(v, at, axis=1) / length
    centred = v - np.repeat(mean, length.astype(int), axis=1)
    deviation = np.sqrt(np.add.reduceat(centred * centred, at, axis=1) / length)
    return np.hstack([mean, deviation]) * np.sqrt(np.hstack([length, length]))


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    offsets = np.append(0, np.cumsum(sizes))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[offsets[at][:, None] + np.arange(size)]


def sketched(rows: DataFrame) -> DataFrame:
    """Adds ``size`` and ``sketch``: which coarse statistics are positive or wide, for the order of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int32)
            sketch = np.zeros(batch.num_rows, np.int64)
            for at, v in vectors(batch.column(0)):
                stats = statistics(v, LEVELS[1])
                half = stats.shape[1] // 2
                bits = np.hstack([stats[:, :half] > 0, stats[:, half:] > stats[:, half:].mean(1, keepdims=True)])
                size[at] = v.shape[1]
                sketch[at] = bits @ (1 << np.arange(bits.shape[1])[::-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(size), pa.array(sketch)], [*batch.schema.names, "size", "sketch"]
            )

    return rows.mapInArrow(run, "v array<long>, ids array<long>, size int, sketch long")


def blocked(rows: DataFrame, block_rows: int) -> DataFrame:
    """Classes in written blocks, by size, sketch and vector: no two rows have equal keys."""
    spark = rows.sparkSession
    listed = stored(sketched(rows), "vectors")
    wanted = min(-(-listed.count() // block_rows), MOST_BLOCKS)
    n = max(1, wanted, min(MOST_BLOCKS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cut = listed.repartitionByRange(n, "size", "sketch", "v")
    return stored(cut.withColumn("block", F.spark_partition_id()), "blocks")


def ranges(blocks: DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(block, size, least, greatest coarse statistics): a row per block and vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(1).to_numpy()
            rows = []
            for at, v in vectors(batch.column(0)):
                stats = statistics(v, LEVELS[1])
                for b in np.unique(block[at]):
                    own = stats[block[at] == b]
                    rows.append((int(b), v.shape[1], own.min(0).tolist(), own.max(0).tolist()))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("block", "size", "low", "high"), r)) for r in rows],
                pa.schema([("block", pa.int32()), ("size", pa.int32()), *[(c, pa.list_(pa.float64())) for c in ("low", "high")]]),
            )

    parts = blocks.select("v", "block").mapInArrow(run, "block int, size int, low array<double>, high array<double>")
    place = parts.select("block", "size", F.posexplode(F.arrays_zip("low", "high")).alias("i", "x"))
    merged = place.groupBy("block", "size", "i").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    listed = merged.groupBy("block", "size").agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("x"))
    return [
        (r["block"], r["size"], np.array([x["low"] for x in r["x"]]), np.array([x["high"] for x in r["x"]]))
        for r in listed.collect()
    ]


def routed(queries: DataFrame, boxes: list, best_only: bool) -> DataFrame:
    """(block, v, bar) of each query and block: the most promising block only, or all others that
    may hold a score of at least the query's ``bar``."""
    by_size: dict[int, tuple] = {}
    for size in {b[1] for b in boxes}:
        own = sorted((b for b in boxes if b[1] == size), key=lambda b: b[0])
        by_size[size] = (
            np.array([b[0] for b in own], np.int32), np.array([b[2] for b in own]), np.array([b[3] for b in own])
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bar = batch.column(1)
            for at, v in vectors(batch.column(0)):
                numbers, low, high = by_size[v.shape[1]]
                stats = statistics(v, LEVELS[1])
                # the greatest product with any value of the range, statistic by statistic
                bound = np.maximum(stats, 0) @ high.T + np.minimum(stats, 0) @ low.T
                best = bound.argmax(1)
                if best_only:
                    q, b = np.arange(len(at)), best
                else:
                    bars = bar.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.float64)
                    open_ = ~(bound + slack(bound) < bars[:, None])  # without a bar all are open
                    open_[np.arange(len(at)), best] = False
                    q, b = np.nonzero(open_)
                rows = pa.array(at[q])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[b]), batch.column(0).take(rows), bar.take(rows)], ["block", "v", "bar"]
                )

    return queries.select("v", "bar").mapInArrow(run, "block int, v array<long>, bar long")


def slack(bound: np.ndarray) -> np.ndarray:
    """What rounding may take from a bound."""
    return 1e-9 * np.abs(bound) + 1e-3


class Search:
    """Queries of one length, each with its best rows so far; candidates pass by."""

    def __init__(self, v: np.ndarray, bar: np.ndarray, keep: int):
        self.v, self.keep = v, keep
        self.levels = [statistics(v, s) for s in LEVELS]
        self.norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        self.bar = bar  # float, -inf as long as there is none
        self.rows = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]  # query, score, id, id is null

    def add(self, v: np.ndarray, ids: list[list]) -> None:
        levels = [statistics(v, s) for s in LEVELS]
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        exact = (np.abs(v).max(initial=0).astype(object) * int(np.abs(self.v).max(initial=0)) * max(v.shape[1], 1)) < 1 << 63
        for first in range(0, len(self.v), TILE[0]):
            part = slice(first, min(first + TILE[0], len(self.v)))
            # rounding grows with the norms, not with a bound near zero
            low = self.bar[part, None] - 1e-9 * self.norm[part, None] * norm.max(initial=0) - 1e-3
            q, c = np.nonzero(self.levels[0][part] @ levels[0].T >= low)
            for own, other in zip(self.levels[1:], levels[1:]):
                stay = []
                for k in range(0, len(q), PAIRS):
                    a, b = q[k : k + PAIRS], c[k : k + PAIRS]
                    stay.append(np.einsum("ij,ij->i", own[part][a], other[b]) >= low[a, 0])
                if stay:
                    stay = np.concatenate(stay)
                    q, c = q[stay], c[stay]
            scores = []
            for k in range(0, len(q), PAIRS):
                a, b = self.v[part][q[k : k + PAIRS]], v[c[k : k + PAIRS]]
                if exact:
                    scores.append((a * b).sum(1))
                else:
                    scores.append(np.array([sum(int(x) * int(y) for x, y in zip(*p)) for p in zip(a, b)], dtype=np.int64))
            if scores:
                self.merge(q + first, np.concatenate(scores), c, ids)

    def merge(self, q: np.ndarray, score: np.ndarray, c: np.ndarray, ids: list[list]) -> None:
        reach = score >= self.bar[q]
        q, score, c = q[reach], score[reach], c[reach]
        count = np.array([len(ids[k]) for k in c.tolist()], np.int64)
        flat = [i for k in c.tolist() for i in ids[k]]
        null = np.array([i is None for i in flat], bool)
        new = [np.repeat(q, count), np.repeat(score, count), np.array([0 if i is None else i for i in flat], np.int64), null]
        rows = [np.concatenate(x) for x in zip(self.rows, new)]
        by = np.lexsort((rows[2], rows[3], -rows[1], rows[0]))
        rows = [x[by] for x in rows]
        head = np.searchsorted(rows[0], rows[0], "left")
        nth = np.arange(len(by)) - head
        self.rows = [x[nth < self.keep] for x in rows]
        full = nth == self.keep - 1
        self.bar[rows[0][full]] = np.maximum(self.bar[rows[0][full]], rows[1][full])

    def answers(self) -> Iterator[pa.RecordBatch]:
        q, score, ids, null = self.rows
        size = self.v.shape[1]
        for k in range(0, len(q), 8192):
            some = slice(k, k + 8192)
            v = self.v[q[some]]
            listed = pa.ListArray.from_arrays(
                pa.array(np.arange(len(v) + 1, dtype=np.int32) * size), pa.array(np.ascontiguousarray(v).ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [listed, pa.array(score[some]), pa.array(ids[some], mask=null[some])], ["v", "score", "vec_id"]
            )


def searched(blocks: DataFrame, routes: DataFrame, chunks: int, keep: int) -> DataFrame:
    """(v, score, vec_id): the best rows of each query in each block that it goes to."""
    cell = ["block", "chunk"]
    asked = routes.select(
        "block", F.pmod(F.xxhash64("v"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(0).alias("side"),
        "v", "bar", F.array().cast("array<long>").alias("ids"),
    )
    # a block goes only to chunks that ask it
    wanted = asked.select(*cell).distinct()
    offered = blocks.join(wanted, "block").select(
        "block", "chunk", F.lit(1).alias("side"), "v", F.lit(None).cast("long").alias("bar"), "ids"
    )
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = asked.unionByName(offered).repartition(parts, *cell).sortWithinPartitions(*cell, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, searches = None, [], {}

        def ready() -> None:
            table = pa.Table.from_batches(waiting)
            bars = table.column("bar").to_numpy().astype(np.float64)
            bars = np.where(np.isnan(bars), -np.inf, bars)
            for at, v in vectors(table.column("v")):
                searches[v.shape[1]] = Search(v, bars[at], keep)
            waiting.clear()

        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            change = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for first, last in zip(edges, edges[1:]):
                if first == last:
                    continue
                key = int(keys[0][first]), int(keys[1][first])
                if key != now:
                    for s in searches.values():
                        yield from s.answers()
                    now, searches = key, {}
                    waiting.clear()
                some = batch.slice(first, last - first)
                if keys[2][first] == 0:
                    waiting.append(some)
                    continue
                if waiting:
                    ready()
                for k in range(0, some.num_rows, TILE[1]):
                    tile = some.slice(k, TILE[1])
                    for at, v in vectors(tile.column("v")):
                        if v.shape[1] in searches:
                            ids = tile.column("ids").take(pa.array(at)).to_pylist()
                            searches[v.shape[1]].add(v, ids)
        for s in searches.values():
            yield from s.answers()

    return rows.mapInArrow(run, ANSWERS_DDL)


def best_rows(found: DataFrame, keep: int) -> DataFrame:
    """(v, place, score, vec_id): the ``keep`` best rows per query."""
    order = Window.partitionBy("v").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)


def top_k(
    embeddings: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE, block_rows: int = BLOCK_ROWS,
    chunk: int = CHUNK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row whose id ``every`` divides.

    Scores are exact inner products of the floored, scaled components; ties go to the smaller id.
    """
    rows = whole(embeddings, scale)
    blocks = blocked(classes(rows, k + 1), block_rows)
    boxes = ranges(blocks)
    asking = stored(rows.filter(F.col("vec_id") % every == 0), "queries")
    no_bar = F.lit(None).cast("long").alias("bar")
    different = asking.select("v").distinct().select("v", no_bar)
    chunks = max(1, -(-asking.count() // chunk))
    near = stored(searched(blocks, routed(different, boxes, True), chunks, k + 1), "near")
    bars = near.groupBy("v").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    barred = different.select("v").join(bars, "v", "left").select(
        "v", F.when(F.col("n") > k, F.col("least")).alias("bar")
    )
    far = searched(blocks, routed(barred, boxes, False), chunks, k + 1)
    best = best_rows(near.unionByName(far), k + 1)
    # rows of one id and vector get the same answers; one row of them is the query's own
    both = asking.groupBy("vec_id", "v").agg(F.count("*").alias("times")).withColumnRenamed("vec_id", "query_id")
    answers = both.join(best, "v").withColumn("own", F.col("vec_id").eqNullSafe(F.col("query_id")))
    ours = F.transform("v", lambda x: x * x)
    same = F.col("own") & (F.col("score") == F.aggregate(ours, F.lit(0).cast("long"), lambda s, x: s + x))
    query = Window.partitionBy("query_id", "v")
    own_place = F.min(F.when(same, F.col("place"))).over(query)
    left = answers.withColumn("own_place", own_place).filter(
        F.col("own_place").isNull() | (F.col("place") != F.col("own_place"))
    )
    shift = F.when(F.col("own_place").isNotNull() & (F.col("place") > F.col("own_place")), 1).otherwise(0)
    ranked = left.withColumn("rank", (F.col("place") - shift).cast("int")).filter(F.col("rank") <= k)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return ranked.select("query_id", "rank", "vec_id", "score", each.alias("_nth")).drop("_nth")
