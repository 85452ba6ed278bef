"""Periodic runs in word sequences, by branching tandem repeats on an enhanced suffix array.

A run is a stretch of words with smallest period q, at least ``max(least, 2 * q)`` long, that no
neighbouring word extends keeping the period.  Texts are handled in groups of whole texts.  A word
is numbered per text, so suffixes of different texts share no prefix and no repeat crosses texts.

Suffixes are sorted by prefix doubling; the ranks of every step stay and answer how far two
places agree.  Each boundary of an LCP interval (depth d) has a child on either side.  The suffixes i
of the smaller side are tried: if the suffix i + d or i - d stands on the other side, the two
begin a square of period d that its next word does not continue.  Such squares are rotated to the
left as far as the words agree, which gives the whole run; of squares that give one stretch the
smallest period counts.  No tree is built, and each suffix is tried at most log2(n) times.

Nulls: a null text has no words and no runs; an id may be null or repeat, every row is judged by
itself.  Empty tables give no rows.  Other columns are ignored, whatever their names.  A text of any
length is one unit: its arrays take about 100 bytes per word, and more if it repeats itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wattframe.llm.common import bind, small, words

LEAST = 12
#: Words of the texts handled at once; a longer text is handled alone.
GROUP = 1 << 17
#: Suffixes tried at once.
STEP = 1 << 20

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def rank_levels(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and per k the rank of the 2^k words at every place.

    Ranks are places of the group's first suffix in the array; only groups of several suffixes are
    sorted again.  The last entry of a level stands for the end and equals nothing.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.append(True, codes[order[1:]] != codes[order[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = head
    levels, width = [rank], 1
    while True:
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order, levels
        suffix = order[tied]
        first, second = rank[suffix], rank[suffix + width]
        by = np.argsort(first.astype(np.int64) * (n + 1) + second, kind="stable")
        suffix, first, second = suffix[by], first[by], second[by]
        order[tied] = suffix
        new[tied] = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        rank = rank.copy()
        rank[suffix] = tied[np.maximum.accumulate(np.where(new[tied], np.arange(len(tied)), 0))]
        levels.append(rank)
        width *= 2


def agreement(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at a and b share (a and b differ)."""
    out = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        out += (levels[k][a + out] == levels[k][b + out]).astype(np.int64) << k
    return out


def agreement_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words before a and before b agree (a < b)."""
    out = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        at = a - out - (1 << k)
        inside = at >= 0
        at = np.maximum(at, 0)
        out += (inside & (levels[k][at] == levels[k][at + b - a])).astype(np.int64) << k
    return out


def sides(lcp: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries p inside intervals, and per boundary the first and past-the-last suffix.

    The left side reaches to a boundary that is as deep or less, the right one to a shallower
    one: an interval with several children is taken apart from the left, child by child.
    """
    at = np.flatnonzero(lcp > 0)
    depth = lcp[at]
    n = len(lcp)
    least = [lcp]  # least[k][p]: the smallest of 2^k entries from p on
    while (1 << len(least)) <= widest:
        half, low = 1 << (len(least) - 1), least[-1]
        least.append(np.minimum(low, np.append(low[half:], np.zeros(min(half, n), low.dtype))[:n]))
    right = at + 1
    left = at.copy()
    for k in reversed(range(len(least))):
        width = 1 << k
        ahead = np.minimum(right, n - 1)
        right = right + width * ((right + width <= n) & (least[k][ahead] >= depth))
        behind = left - width
        left = left - width * ((behind > 0) & (least[k][np.maximum(behind, 0)] > depth))
    return at, left - 1, right


def squares(order: np.ndarray, lcp: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square that the word after it does not continue."""
    n = len(order)
    place = np.full(n + 1, -1, np.int64)
    place[order] = np.arange(n)
    mid, low, high = sides(lcp, widest)
    is_left = mid - low <= high - mid
    begin = np.where(is_left, low, mid)
    count = np.where(is_left, mid - low, high - mid)
    other = np.where(is_left, mid, low), np.where(is_left, high, mid)
    ends = np.cumsum(count)
    starts, periods = [], []
    done = 0
    while done < len(mid):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + STEP, "right")))
        some = slice(done, upto)
        node = np.repeat(np.arange(done, upto), count[some])
        offset = np.arange(len(node)) - np.repeat(ends[some] - count[some] - (ends[done] - count[done]), count[some])
        i = order[begin[node] + offset]
        depth = lcp[mid[node]].astype(np.int64)
        for j, first in ((i + depth, i), (i - depth, i - depth)):
            there = place[np.clip(j, 0, n)]
            hit = (j >= 0) & (j < n) & (there >= other[0][node]) & (there < other[1][node])
            starts.append(first[hit])
            periods.append(depth[hit])
        done = upto
    return np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(periods or [np.zeros(0, np.int64)])


def runs(codes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period.  Equal codes are equal words."""
    none = np.zeros(0, np.int64)
    if len(codes) < 2:
        return none, none, none
    order, levels = rank_levels(codes)
    inside = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    lcp = np.zeros(len(codes), np.int32)
    lcp[inside] = agreement(levels, order[inside - 1], order[inside])
    widest = int(np.bincount(levels[0][:-1]).max())
    at, period = squares(order, lcp, widest)
    end = at + 2 * period
    start = at - agreement_before(levels, at, at + period)
    long = end - start >= least
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, period = start[first], end[first], period[first]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def judged(texts: list[list[str]], least: int) -> tuple[pa.Array, list[str]]:
    """Runs of each text (its words) and the words that stay, joined."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.append(0, np.cumsum(sizes))
    flat = [w for t in texts for w in t]
    if flat:
        kinds = pa.array(flat, pa.large_string()).dictionary_encode().indices.to_numpy().astype(np.int64)
    else:
        kinds = np.zeros(0, np.int64)
    codes = np.repeat(np.arange(len(texts)), sizes) * (len(flat) + 1) + kinds
    start, end, period = runs(codes, least)
    owner = np.searchsorted(offsets, start, "right") - 1
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, end, -1)
    gone = np.cumsum(cover) > 0
    touched = set(owner.tolist())
    left = []
    for k, t in enumerate(texts):
        if k in touched:
            stay = ~gone[offsets[k] : offsets[k + 1]]
            t = [w for w, s in zip(t, stay.tolist()) if s]
        left.append(" ".join(t))
    per_text = np.append(0, np.cumsum(np.bincount(owner, minlength=len(texts))))
    values = pa.StructArray.from_arrays(
        [pa.array(start - offsets[owner]), pa.array(end - start), pa.array(period)], fields=list(RUN)
    )
    return pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), values), left


def detect(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row.

    ``runs``: array of (start, length, period), by start and period, in words from 0.  ``collapsed``: the
    text's words, each run reduced to its first period, joined by one space.
    """
    kind = docs.schema[id_column].dataType
    schema = pa.schema(
        [
            (id_column, to_arrow_type(kind)),
            ("n_words", pa.int64()),
            ("runs", pa.list_(RUN)),
            ("collapsed", pa.large_string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 256):
            ids = batch.column(0).cast(schema.field(0).type)
            held, first, total = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                held.append(WORD.findall(text.as_py() or ""))
                total += len(held[-1])
                if total < GROUP and k + 1 < batch.num_rows:
                    continue
                found, left = judged(held, least)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(held)),
                        pa.array([len(t) for t in held], pa.int64()),
                        found.cast(schema.field(2).type),
                        pa.array(left, pa.large_string()),
                    ],
                    schema=schema,
                )
                held, first, total = [], k + 1, 0

    listed = docs.select(id_column, text_column)
    out = f"`{id_column}` {kind.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return listed.mapInArrow(run, out)


def planted(id_column: Column, text: Column) -> Column:
    """The text of every tenth id by checksum with a periodic end; other texts as they are.

    Rows without an id keep their text.
    """
    h = F.crc32(id_column.cast("string"))
    g = F.floor(h / 10)

    def rewritten(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % F.greatest(n, F.lit(1).cast("long"))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        word = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        listed = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, word(i).cast("int")))
        return F.when(n > 0, F.array_join(listed, " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, bind(words(text), rewritten)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """One row per document: runs counted, the longest one, checksums of runs and of what stays."""
    better = lambda x, y: (
        F.when(x["length"] != y["length"], y["length"] - x["length"])
        .when(x["start"] != y["start"], x["start"] - y["start"])
        .otherwise(x["period"] - y["period"])
    )
    best = F.get(F.array_sort("runs", lambda x, y: better(x, y).cast("int")), F.lit(0))
    lines = F.transform(
        "runs", lambda r: F.concat_ws(",", *[r[f].cast("string") for f in ("start", "length", "period")])
    )
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    top = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of all documents, every tenth given a periodic end before (:func:`planted`)."""
    texts = docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    return digests(detect(texts))
