"""Near-duplicate documents: n-gram Jaccard join by MinHash banding.

A document is the set of its five-word windows, hashed to 64 bits; a shorter one is one window.
Band and row counts follow from the recall wanted at the similarity asked for (``banding``).
Documents that share a band hash become candidates, candidate groups are found as connected
components of band hashes, and inside a group every pair is verified on the full sets.

Equal texts are one class, compared once, so copies never meet.  A group too large for a task
is cut into cells, and each pair of cells is a task: no pair is left out, none becomes a row.
What a cell gives out is a number per class and a spanning forest of its links.

Null texts and texts without words link with nothing and are classes of their own.  Texts are read whole.  Rows that repeat
are copies of each other.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.common import small, unused
from wattframe.llm.graph import Union, components
from wattframe.session import stored

WORDS, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.99999, 6
#: Windows of the classes in a cell; a task holds two cells.
CELL = 200_000
#: Classes in candidate groups up to which their ids are broadcast to the texts (24 bytes each);
#: with more of them texts and ids are shuffled.
BROADCAST_ROWS = 2_000_000
#: Bytes of text hashed at once; a longer text is taken alone.
STEP = 1 << 19

BREAKS = np.zeros(256, bool)
BREAKS[[32, 9, 10, 11, 12, 13]] = True


def banding(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> tuple[int, int]:
    """(bands, rows) with which a pair at the similarity shares a band at that rate or more."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows))), rows


@functools.cache
def constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        out = np.ones(n, np.uint64)
        done = 1
        while done < n:  # doubling: the next stretch is the last one times a power
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(b, done, 1 << 64))
            done += step
        both.append(out)
    return both[0], both[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def windows(texts: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of all texts, where each text's begin, and words per text.

    A text with fewer words has one window, one without words none.
    """
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = BREAKS[data]
    start = ~space
    start[1:] &= space[:-1]
    first = np.flatnonzero(start)
    stop = ~space[:-1] & space[1:]
    last = np.flatnonzero(stop) + 1
    # a word is its bytes times falling powers, taken from running sums
    size = max(1 << 16, 1 << int(len(data) - 1).bit_length())
    up, down = powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(constants(256, 1)[data] * up[: len(data)], out=sums[1:])
    word = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    at = np.searchsorted(first, ends)  # words before the end of each text
    n_words = np.diff(at, prepend=0)
    total = len(word)
    hashed = np.zeros(total, np.uint64)
    for k in range(n):
        hashed[: max(total - k, 0)] = hashed[: max(total - k, 0)] * np.uint64(0xD6E8FEB86659FD93) + word[k:]
    begin = at - n_words
    count = np.where(n_words >= n, n_words - n + 1, np.minimum(n_words, 1))
    for i in np.flatnonzero((n_words > 0) & (n_words < n)):  # one window of all words
        h = int(n_words[i])
        for w in word[begin[i] : at[i]]:
            h = (h * 0xD6E8FEB86659FD93 + int(w)) % (1 << 64)
        hashed[begin[i]] = h
    offsets = np.cumsum(count) - count
    take = np.arange(count.sum()) - np.repeat(offsets - begin, count)
    return mixed(hashed[take]), offsets, n_words


def signatures(hashes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Least value of n hash functions over each text's windows; offsets of non-empty texts."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.empty((n, len(offsets)), np.uint32)
    for k, c in enumerate(constants(n, 2)):
        c = int(c)
        v = (low ^ np.uint32(c >> 32)) * np.uint32(c & 0xFFFFFFFF | 1)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        out[k] = np.minimum.reduceat(v, offsets)
    return out


def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > STEP:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def banded(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, n_windows, bands) of every document; node is a hash of the text."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("node", pa.int64()), ("n_windows", pa.int64()), ("bands", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [x or b"" for x in batch.column("data").to_pylist()]
            for first, last in groups(texts):
                hashes, offsets, n_words = windows(texts[first:last])
                some = np.flatnonzero(n_words > 0)
                count = np.diff(np.append(offsets, len(hashes)))
                keys = np.zeros((len(some), bands), np.uint64)
                if len(some):
                    least = signatures(hashes, offsets[some], bands * rows)
                    for b in range(bands):
                        h = np.full(len(some), b + 1, np.uint64)
                        for r in least[b * rows : (b + 1) * rows]:
                            h = h * np.uint64(0xD6E8FEB86659FD93) + r
                        keys[:, b] = mixed(h)
                per_row = np.zeros(last - first, np.int32)
                per_row[some] = bands
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(per_row)).astype(np.int32)), pa.array(keys.ravel().view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        batch.column("node").slice(first, last - first),
                        pa.array(count.astype(np.int64)),
                        lists,
                    ],
                    schema=schema,
                )

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("node"),
        F.col("text").cast("binary").alias("data"),
    )
    return texts.mapInArrow(run, "doc_id long, node long, n_windows long, bands array<long>")


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between classes that share a band hash: each to the first one of the hash.

    Classes are shuffled once on their band hashes and read in order; a hash that many share
    is passed through row by row and never held.
    """
    # the number of the band is part of its hash, so equal hashes mean equal bands
    keyed = classes.select(F.explode("bands").alias("key"), "node")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new = np.append(True, keys[1:] != keys[:-1])
            if key is not None and keys[0] == key:
                new[0] = False
            run_of = np.cumsum(new)
            heads = np.append(first if first is not None else 0, nodes[new])
            head = heads[run_of]
            key, first = keys[-1], head[-1]
            edge = np.flatnonzero(head != nodes)
            yield pa.RecordBatch.from_arrays([pa.array(head[edge]), pa.array(nodes[edge])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray], left: int, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the first ``left`` sets (all, if 0): itself and later sets that are near.

    With ``left``, pairs lie across the two halves only.  Windows are numbered and listed per
    number; a set's overlap with all others is one count over its lists.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    number, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(inverse, kind="stable")
    listed = owner[order]
    starts = np.searchsorted(inverse[order], np.arange(len(number) + 1))
    begin = np.cumsum(sizes) - sizes
    often = np.diff(starts) > 1
    for i in range(left or n):
        own = inverse[begin[i] : begin[i] + sizes[i]]
        own = own[often[own]]
        if not len(own):
            continue
        # places in the lists of all windows of this set
        first, length = starts[own], starts[own + 1] - starts[own]
        take = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
        both = np.bincount(listed[take], minlength=n)
        low = left or i + 1
        both = both[low:]
        # an exact test of the ratio, in whole numbers
        near = both * (1000 + round(1000 * similarity)) >= round(1000 * similarity) * (sizes[i] + sizes[low:])
        near &= both > 0
        found = np.flatnonzero(near) + low
        if len(found):
            yield i, found


def verified(docs: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """(node, links, root) of all near pairs inside the candidate groups."""
    sizes = members.groupBy("root").agg(F.ceil(F.sum("n_windows") / CELL).cast("int").alias("cells"))
    placed = members.join(sizes, "root").withColumn("cell", F.pmod(F.xxhash64("node", F.lit(7)), "cells").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    paired = (
        placed.select("*", other.alias("other"))
        .withColumn("low", F.least("cell", "other"))
        .withColumn("high", F.greatest("cell", "other"))
    )
    texts = docs.select(
        F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_node"), F.col("text").cast("binary").alias("data")
    )
    ids = members.select("node", "first_id")
    if members.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    same = (F.col("node") == F.col("_node")) & F.col("first_id").eqNullSafe(F.col("_id"))
    held = texts.join(ids, same).select("node", "data")
    rows = paired.select("root", "low", "high", "cell", "node", "copies").join(held, "node")
    keys = ["root", "low", "high"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(4 * parts, *keys).sortWithinPartitions(*keys, "cell", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["root"], row["low"], row["high"])
                if key != now:
                    if len(held) > 1:
                        yield cell(held)
                    now, held = key, []
                if not held or held[-1]["node"] != row["node"]:  # a row that repeats
                    held.append(row)
        if len(held) > 1:
            yield cell(held)

    def cell(rows: list[dict]) -> pa.RecordBatch:
        across = rows[0]["low"] != rows[0]["high"]
        left = sum(r["cell"] == rows[0]["cell"] for r in rows) if across else 0
        sets = [np.unique(windows([r["data"]])[0]) for r in rows]
        nodes = np.array([r["node"] for r in rows], np.int64)
        copies = np.array([r["copies"] for r in rows], np.int64)
        links, union = np.zeros(len(rows), np.int64), Union(len(rows))
        if not (across and left == len(rows)):
            for i, found in overlaps(sets, left, similarity):
                links[i] += copies[found].sum()
                links[found] += copies[i]
                for j in found:
                    if union.up[j] != union.up[i] or union.up[j] == j:
                        union.link(i, int(j))
        at, root = union.forest()
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([nodes[some], nodes[at]])),
                pa.array(np.concatenate([links[some], np.zeros(len(at), np.int64)])),
                pa.array(np.concatenate([nodes[some], nodes[root]])),
            ],
            ["node", "links", "root"],
        )

    return dealt.mapInArrow(run, "node long, links long, root long")


def judged(docs: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node, n_windows), and per different text with words (node) its smallest id, its
    copies, its links to other texts and the ``root`` of its class."""
    bands, rows = banding(similarity, recall)
    known = stored(banded(docs, bands, rows), "banded")
    classes = known.filter("n_windows > 0").groupBy("node").agg(
        F.min("doc_id").alias("first_id"),
        F.count("*").alias("copies"),
        F.first("n_windows").alias("n_windows"),
        F.first("bands").alias("bands"),
    )
    classes = stored(classes, "classes")
    groups_ = components(candidates(classes)).withColumnRenamed("id", "node")
    members = stored(classes.drop("bands").join(groups_, "node"), "members")
    found = stored(verified(docs, members, similarity), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(edges).withColumnRenamed("id", "node")
    own = (
        classes.select("node", "copies", "first_id")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    return known, own


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: its class, number of links and whether it stays.

    ``n_links``: other documents at the similarity or more.  ``class_id``: smallest doc_id
    reachable by links, itself included.  ``kept``: the document whose id that is.
    """
    known, own = judged(docs, similarity, recall)
    smallest = own.groupBy("root").agg(F.min("first_id").alias("class_id"))
    own = own.join(smallest, "root").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "class_id"
    )
    worded = known.filter("n_windows > 0")
    linked = worded.select("doc_id", "node").join(own, "node").select("doc_id", "n_links", "class_id")
    alone = known.filter("n_windows = 0").select(
        "doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``docs`` less every row but one of each class; rows without words are classes of their own.

    A class is told by its texts, not by its ids, which may repeat or be null: its row with the smallest
    id stays (null last), of rows with equal id and text the first by the other columns.
    """
    _, own = judged(docs, similarity, recall)
    order = F.struct(F.col("first_id").isNull(), "first_id", "node")
    stays = own.groupBy("root").agg(F.min_by(F.struct("node", "first_id", "copies"), order).alias("x"))
    node, first, copies, nth = unused(docs, "node", "first_id", "copies", "nth")
    stays = stored(
        stays.select(F.col("x.node").alias(node), F.col("x.first_id").alias(first), F.col("x.copies").alias(copies)), "stays"
    )
    if stays.count() <= BROADCAST_ROWS:
        stays = F.broadcast(stays)
    same = (F.xxhash64(docs["text"]) == F.col(node)) & docs["doc_id"].cast("long").eqNullSafe(F.col(first))
    left = docs.join(stays, same)
    single = left.filter(F.col(copies) == 1).select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    by_rest = Window.partitionBy(node).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])) if rest else F.lit(1))
    several = left.filter(F.col(copies) > 1).withColumn(nth, F.row_number().over(by_rest))
    several = several.filter(F.col(nth) == 1).select(*docs.columns)
    worded = F.coalesce(docs["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return single.unionByName(several).unionByName(docs.filter(~worded))
