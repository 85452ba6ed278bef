"""Repeated passages by merging Burrows-Wheeler transforms.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier: in a
document with a smaller id, or before in the same one.  Strings never cross documents.

1. Every string of that length has an anchor, the window inside it with the least hash; equal
   strings have equal anchors.  A stretch of starts with one anchor is a context.  Contexts
   meet on their anchor's hash, and an anchor whose context nothing else shares is left out:
   no string of it can occur twice.  Equal contexts are one string, whose later copies go.
2. What is left, different contexts with one anchor, is dealt over tasks by anchor.  An anchor
   with very many of them is dealt string by string: a task that cuts strings out keeps the
   first place of each, and of what meets after that one place per string is held.  A task
   cuts its strings into shards, sorts the suffixes of each shard and keeps its transform.
3. The transforms are merged by refining their interleave (Holt and McMillan, 2014): a pass
   takes every suffix one character further left, so after k passes the order is right for k
   characters, and a block of the merged order is an interval of suffixes with k characters in
   common (Egidi and Manzini, 2017).  Passes end after ``LENGTH``, or when no block splits any
   more; no suffix of another shard is compared.  In an interval all starts but the earliest
   are repeated.

Texts are UTF-8 bytes, read whole; a null text is empty.  Equal texts are copies: of them only
the one with the smallest id is searched, the others go whole if long enough.  Rows that repeat
id and text are alike: they count as one document, and all of them stay or lose the same bytes.
A null id counts as the largest.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import small
from wattframe.llm.ngram_join import constants, mixed, powers
from wattframe.session import stored

LENGTH, ANCHOR = 100, 32
#: Starts handled at once, suffixes of a shard and of a task.
STEP, SHARD, TASK = 1 << 18, 1 << 15, 1 << 18
#: Different contexts of one anchor above which its strings are dealt over several tasks; first
#: places of such strings that a task holds, and parts over which places that repeat are dealt.
CROWD, HELD, SPREAD = 20_000, 1 << 17, 1 << 16
#: Texts with copies, or rows of places, up to which a side is broadcast; beyond it is shuffled.
BROADCAST_ROWS = 1_000_000
LAST = (1 << 63) - 1


def contexts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, anchor: int):
    """(segment, first, last, anchor, anchor hash, context hash) of the contexts of all segments.

    Segments lie one after the other in ``data``; a start is good if its string ends in its
    segment.
    """
    total, width = len(data), length - anchor + 1
    good = sizes >= length
    if not good.any():
        return None
    up, down = powers(max(1 << 16, 1 << int(total).bit_length()))
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum(constants(256, 3)[data] * up[:total], out=sums[1:])
    grams = total - anchor + 1
    hashed = mixed((sums[anchor:] - sums[:grams]) * down[:grams])
    low = np.uint64((1 << 24) - 1)
    keys = (hashed & ~low) | np.arange(grams, dtype=np.uint64)
    padded = -(-grams // width) * width
    keys = np.append(keys, np.full(padded - grams + width, ~np.uint64(0)))
    table = keys.reshape(-1, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n_starts = np.where(good, sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), n_starts)
    at = np.arange(n_starts.sum()) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts) + starts[owner]
    chosen = (np.minimum(after[at], before[at + width - 1]) & low).astype(np.int64)
    new = np.append(True, (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1]))
    head = np.flatnonzero(new)
    first, last = at[head], at[np.append(head[1:], len(at)) - 1]
    place = chosen[head]
    shape = ((place - first) * 256 + (last - first)).astype(np.uint64)
    text = mixed((sums[last + length] - sums[first]) * down[first])
    return owner[head], first, last, place, hashed[place], mixed(text + shape * np.uint64(0x9E3779B97F4A7C15))


def packed(first, count, before, tag):
    """A stretch of starts, how far its anchor lies behind the first, and the mark of its text in
    one number, ordered by the first start."""
    return (first << 30) | (count << 23) | (before << 16) | tag


def opened(place):
    """First start, number of starts, way to the anchor."""
    return place >> 30, (place >> 23) & 127, (place >> 16) & 127


def segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, place of its first byte, bytes); long texts in pieces that overlap."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for begin in range(0, max(len(t) - length + 1, 0), STEP):
            piece = t[begin : begin + STEP + length - 1]
            if group and size + len(piece) > STEP:
                yield group
                group, size = [], 0
            group.append((i, begin, piece))
            size += len(piece)
    if group:
        yield group


def anchored(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(anchor, context, ord, place) of every context of (ord, tag, data)."""
    names = ["anchor", "context", "ord", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            order = batch.column("ord").to_numpy(zero_copy_only=False)
            tags = batch.column("tag").to_numpy(zero_copy_only=False)
            for group in segments(batch.column("data").to_pylist(), length):
                row = np.array([g[0] for g in group])
                begin = np.array([g[1] for g in group], np.int64)
                sizes = np.array([len(g[2]) for g in group])
                starts = np.cumsum(sizes) - sizes
                data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
                found = contexts(data, starts, sizes, length, anchor)
                if found is None:
                    continue
                owner, first, last, at, gram, text = found
                begins = first - starts[owner] + begin[owner]
                place = packed(begins, last - first + 1, at - first, tags[row[owner]])
                columns = [gram.view(np.int64), text.view(np.int64), order[row[owner]], place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return texts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def matched(rows: DataFrame) -> DataFrame:
    """Places that repeat a context (``again``), and the first place of each different context
    where an anchor has several.

    Rows are read in the order of anchor, context and place, and passed through one by one; of
    an anchor only its first row is held until it is known whether there is another context.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["anchor", "context", "ord", "place"]
    dealt = rows.repartition(parts, "anchor").sortWithinPartitions(*names)

    def out(columns: list[np.ndarray], again: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(columns[i]) for i in (0, 2, 3)] + [pa.array(again)]
        return pa.RecordBatch.from_arrays(arrays, ["anchor", "ord", "place", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous = None  # anchor, context and first place of the run that is open
        held = None  # the only context of the open anchor so far
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if previous is None:
                old = np.array([True]), np.array([True])
            else:
                other = c[0][:1] != previous[0]
                old = other, other | (c[1][:1] != previous[1])
            new_anchor = np.append(old[0], c[0][1:] != c[0][:-1])
            new_run = np.append(old[1], new_anchor[1:] | (c[1][1:] != c[1][:-1]))
            heads = np.flatnonzero(new_run)
            # the first row of each run; rows equal to it are the same document
            run_of = np.cumsum(new_run) - 1
            lead = [np.append(previous[j] if previous else 0, c[j][heads])[run_of + 1] for j in (2, 3)]
            later = (c[2] != lead[0]) | (c[3] != lead[1])
            if later.any():
                yield out([x[later] for x in c], np.ones(later.sum(), bool))
            group = np.cumsum(new_anchor)[heads]  # 0: the anchor that is open
            several = np.bincount(group, minlength=int(new_anchor.sum()) + 1)
            if several[0] and held is not None:
                yield out(held, np.zeros(1, bool))
                held = None
            open_anchor = int(new_anchor.sum())
            shown = several[group] > 1
            if several[0]:
                shown |= group == 0
            if shown.any():
                at = heads[shown]
                yield out([x[at] for x in c], np.zeros(len(at), bool))
            if open_anchor:
                last = heads[group == open_anchor]
                held = [x[last] for x in c] if len(last) == 1 else None
            previous = (c[0][-1], c[1][-1], lead[0][-1], lead[1][-1])

    return dealt.mapInArrow(run, "anchor long, ord long, place long, again boolean")


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of one shard: string and offset of its suffixes in order.

    Bytes are raised by one, so that 0 ends a string; UTF-8 leaves room for that.
    """
    sizes = np.array([len(s) + 1 for s in strings])
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).copy()
    stops = np.cumsum(sizes) - 1
    data += 1
    data[stops] = 0
    owner = np.repeat(np.arange(len(strings)), sizes)
    offset = np.arange(len(data)) - (np.cumsum(sizes) - sizes)[owner]
    width = int(sizes.max())
    view = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(width, np.uint8)), width)[: len(data)]
    # bytes behind the end of a string do not count
    fixed = np.where(np.arange(width)[None, :] < (sizes[owner] - offset)[:, None], view, 0).astype(np.uint8)
    order = np.argsort(np.ascontiguousarray(fixed).view(f"S{width}").ravel(), kind="stable")
    return owner[order], offset[order]


def steps(strings: list[bytes], owner: np.ndarray, offset: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of a shard, in order: the ``by`` characters to its left, as one symbol, and
    the rank of the suffix that begins with them.  A string is followed by its own end."""
    sizes = np.array([len(s) + 1 for s in strings])
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8) + np.uint8(1)
    data[base + sizes - 1] = 0
    at = base[owner] + offset
    rank = np.empty(len(data), np.int32)
    rank[at] = np.arange(len(data), dtype=np.int32)
    back = base[owner] + (offset - by) % sizes[owner]
    symbol = data[back].astype(np.uint16 if by == 2 else np.uint8)
    if by == 2:
        next_ = base[owner] + (offset - 1) % sizes[owner]
        symbol = (symbol << np.uint16(8)) | data[next_]
        symbol[symbol < 256] = 0  # the end of a string, whatever follows it
    return symbol, rank[back]


def merge(shards: list[tuple[np.ndarray, np.ndarray]], depth: int, by: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix (numbered shard by shard) at every place of the merged order, and its block.

    ``shards`` have the symbol to the left of each suffix and where that leads; ``by`` is the
    number of characters in a symbol.  A block is an interval of suffixes that agree in
    ``depth`` characters, or in all of them.
    """
    sizes = [len(s) for s, _ in shards]
    left = np.concatenate([s for s, _ in shards])
    leads = np.concatenate([x + base for (_, x), base in zip(shards, np.cumsum(sizes) - sizes)])
    # symbol and lead of a suffix are read together
    both = leads.astype(np.int64) << 16 | left
    interleave = np.arange(len(left), dtype=np.int32)
    block, blocks = np.zeros(len(left), np.int32), 1
    ends = int((left == 0).sum())
    for _ in range(-(-depth // by)):
        found = both[interleave]
        source = np.argsort(found.astype(left.dtype), kind="stable")
        found, old = found[source], block[source]
        symbol, interleave = found.astype(left.dtype), (found >> 16).astype(np.int32)
        # what is no longer than a symbol stays in the order of the shards
        interleave[:ends].sort()
        short = np.zeros(len(left), bool)
        if by == 2:
            short = (symbol & np.uint16(255)) == 0
            at = np.flatnonzero(short[ends:]) + ends
            interleave[at] = interleave[at][np.lexsort((interleave[at], symbol[at]))]
        short[:ends] = True
        split = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1]) & ~short[1:]
        block[0] = 0
        np.cumsum(split, out=block[1:])
        if block[-1] + 1 == blocks:
            break
        blocks = int(block[-1]) + 1
    return interleave, block


def repeats(strings: list[bytes], order: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """(string, offset) of the starts whose string also starts at an earlier place."""
    by = 1 if length % 2 else 2
    parts, owners, offsets, shard, size = [], [], [], [], 0
    for i, s in enumerate([*strings, None]):
        if shard and (s is None or size + len(s) + 1 > SHARD):
            owner, offset = transform(shard)
            parts.append(steps(shard, owner, offset, by))
            owners.append(owner + i - len(shard))
            offsets.append(offset)
            shard, size = [], 0
        if s is not None:
            shard.append(s)
            size += len(s) + 1
    merged, block = merge(parts, length, by)
    owner, offset = np.concatenate(owners)[merged], np.concatenate(offsets)[merged]
    sizes = np.array([len(s) for s in strings])
    whole = np.flatnonzero(sizes[owner] - offset >= length)
    own, far, group = owner[whole], offset[whole], block[whole]
    ranked = np.lexsort((place[own] + far, order[own], group))
    first = np.append(True, group[ranked][1:] != group[ranked][:-1])
    hit = ranked[~first]
    return np.stack([own[hit], far[hit]])


def sharing(strings: list[bytes], group: np.ndarray, before: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """Strings that may share one of ``length`` bytes with another of their group.

    Strings are laid on each other by their anchor, ``before`` bytes in.  A shared string reaches
    some way to the left of the anchor; for each quarter of the possible ways, it holds a
    stretch around the anchor that then must be the same.
    """
    rest = length - anchor
    step = -(-(rest + 1) // 4)
    sizes = np.array([len(s) for s in strings])
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(strings), np.uint8)
    up, down = powers(max(1 << 16, 1 << int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(constants(256, 4)[data] * up[: len(data)], out=sums[1:])
    keep = np.zeros(len(strings), bool)
    for least in range(0, rest + 1, step):
        most = min(least + step - 1, rest)
        begin, end = before - least, before + anchor + rest - most
        fits = np.flatnonzero((begin >= 0) & (end <= sizes))
        if len(fits) < 2:
            continue
        a, b = base[fits] + begin[fits], base[fits] + end[fits]
        key = mixed((sums[b] - sums[a]) * down[a] + group[fits].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        keep[fits[order[np.append(False, same) | np.append(same, False)]]] = True
    return keep


def compared(strings: DataFrame, length: int, anchor: int) -> DataFrame:
    """Places that repeat an earlier string, among (anchor, part, ord, place, data).  Where there
    is no data the place is known to repeat one."""
    parts = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = strings.repartition(2 * parts, "anchor", "part")
    dealt = dealt.sortWithinPartitions("anchor", "part", "data", "ord", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None
        for batch in batches:
            again: list[tuple[int, int]] = []
            for row in batch.to_pylist():
                if row["data"] is None:
                    again.append((row["ord"], row["place"]))
                    continue
                now = (row["anchor"], row["part"])
                if now == key and row["part"] and row["data"] == held[-1]["data"]:
                    # the first of equal strings is held; rows equal to it are the same document
                    if (row["ord"], row["place"]) != (held[-1]["ord"], held[-1]["place"]):
                        again.append((row["ord"], row["place"]))
                    continue
                if now != key and size > TASK:
                    yield found(held)
                    held, size = [], 0
                key = now
                held.append(row)
                size += len(row["data"]) + 1
            if again:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*again)], ["ord", "place"])
        if held:
            yield found(held)

    def found(rows: list[dict]) -> pa.RecordBatch:
        order = np.array([r["ord"] for r in rows], np.int64)
        place = np.array([r["place"] for r in rows], np.int64)
        first, _, before = opened(place)
        group = np.cumsum([0] + [(a["anchor"], a["part"]) != (b["anchor"], b["part"]) for a, b in zip(rows, rows[1:])])
        # a row that repeats is the same document: one of them is enough
        alone = np.append(True, (order[1:] != order[:-1]) | (place[1:] != place[:-1]))
        use = np.flatnonzero(alone)
        texts = [rows[i]["data"] for i in use]
        use = use[sharing(texts, group[use], before[use], length, anchor)]
        if not len(use):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["ord", "place"])
        own, far = repeats([rows[i]["data"] for i in use], order[use], first[use], length)
        in_turn = np.lexsort((far, own))
        at, far = use[own[in_turn]], far[in_turn]
        # starts that follow each other in a string are one stretch
        head = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (far[1:] != far[:-1] + 1))[: len(at)])
        count = np.diff(np.append(head, len(at)))
        at = at[head]
        out = packed(first[at] + far[head], count, 0, place[at] & 65535)
        return pa.RecordBatch.from_arrays([pa.array(order[at]), pa.array(out)], ["ord", "place"])

    return dealt.mapInArrow(run, "ord long, place long")


class Firsts:
    """The first place of each string that a task has met, of bounded number."""

    def __init__(self):
        self.rows: dict[tuple[int, bytes], tuple[int, int, int]] = {}

    def add(self, anchor: int, part: int, order: int, place: int, text: bytes) -> tuple | None:
        """A row of a place, this one or the one held so far, that repeats the string."""
        held = self.rows.get((anchor, text))
        if held is None or (order, place) < held[1:]:
            self.rows[anchor, text] = (part, order, place)
        if held is None or (order, place) == held[1:]:
            return None
        order, place = max((order, place), held[1:])
        return anchor, -1 - (order * 31 + (place >> 30)) % SPREAD, order, place, None

    def taken(self) -> list[tuple]:
        """The rows of the first places, which are no longer held."""
        out = [(anchor, *row, text) for (anchor, text), row in self.rows.items()]
        self.rows = {}
        return out


def cut_out(texts: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(anchor, part, ord, place, data): the strings of (anchor, splits, ord, place).  Of equal
    strings of a crowded anchor a task gives the first; the others have no data and parts below
    0, which spread them."""
    listed = places.groupBy("ord", "tag").agg(F.collect_list(F.struct("anchor", "splits", "place")).alias("places"))
    schema = "anchor long, part long, ord long, place long, data binary"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["anchor", "part", "ord", "place", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = Firsts()
        for batch in small(batches):
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out = []
                for p in row["places"]:
                    first, count, before = opened(p["place"])
                    if not p["splits"]:
                        text = row["data"][first : first + count + length - 1]
                        out.append((p["anchor"], 0, row["ord"], p["place"], text))
                        continue
                    for start in range(first, first + count):
                        text = row["data"][start : start + length]
                        digest = hashlib.blake2b(text, digest_size=8).digest()
                        part = 1 + int.from_bytes(digest, "little") % p["splits"]
                        place = packed(start, 1, first + before - start, p["place"] & 65535)
                        again = firsts.add(p["anchor"], part, row["ord"], place, text)
                        if again:
                            out.append(again)
                    if len(firsts.rows) > HELD:
                        out += firsts.taken()
                if out:
                    yield batch_of(out)
        rest = firsts.taken()
        for i in range(0, len(rest), 10_000):
            yield batch_of(rest[i : i + 10_000])

    return joined(texts, listed, places).select("ord", "data", "places").mapInArrow(run, schema)


def joined(texts: DataFrame, listed: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Texts with their lists of places; the lists are broadcast up to a checked size."""
    if rows.count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    return texts.join(listed, ["ord", "tag"], how)


def covered(places: list[int] | None, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal stretches of bytes that strings from these starts cover."""
    out: list[list[int]] = []
    for place in sorted(places or ()):
        begin, count, _ = opened(place)
        end = begin + count - 1 + length
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def removed(docs: DataFrame, length: int) -> DataFrame:
    """The result rows of (doc_id, data, copy, places)."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            ids = batch.column("doc_id").to_pylist()
            copy = batch.column("copy").to_pylist()
            for i, (data, places) in enumerate(zip(batch.column("data").to_pylist(), batch.column("places").to_pylist())):
                if copy[i] and len(data) >= length:
                    spans = [(0, len(data))]
                else:
                    spans = covered(places, len(data), length)
                digest, last = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(data[last:a])
                    last = b
                digest.update(data[last:])
                gone = sum(b - a for a, b in spans)
                out.append((ids[i], len(data), gone, len(spans), digest.hexdigest()))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return docs.select("doc_id", "data", "copy", "places").mapInArrow(run, schema)


def tag_of(place: Column) -> Column:
    return place.bitwiseAND(F.lit(65535)).alias("tag")


def deduplicate(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """One row per document: bytes, bytes removed, their spans, and the digest of what stays."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = narrow.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(LAST)).alias("ord"),
        F.xxhash64("text").alias("node"),
        F.col("text").cast("binary").alias("data"),
    ).withColumn("tag", F.pmod("node", F.lit(65536)))
    known = texts.select("ord", "node").groupBy("node").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    several = stored(known.filter("first <> last").select("node", "first"), "copies")
    if several.count() <= BROADCAST_ROWS:
        several = F.broadcast(several)
    marked = texts.join(several, "node", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("ord"), F.lit(False)))
    searched = marked.filter(~F.col("copy") & (F.length("data") >= length)).select("ord", "tag", "data")

    found = stored(matched(anchored(searched, length, anchor)), "matches")
    different = found.filter("not again").select("anchor", "ord", "place", tag_of(F.col("place")))
    starts = F.shiftright("place", 23).bitwiseAND(F.lit(127))
    crowded = (
        different.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(starts).alias("starts"))
        .filter(F.col("n") > CROWD)
        .select("anchor", F.ceil(F.col("starts") * (length + 1) / TASK).alias("splits"))
    )
    places = different.join(crowded, "anchor", "left").fillna(0, ["splits"])
    strings = cut_out(searched, places, length)
    more = stored(compared(strings, length, anchor), "repeats")

    all_places = found.filter("again").select("ord", "place").unionByName(more)
    all_places = all_places.select("ord", tag_of(F.col("place")), "place")
    listed = all_places.groupBy("ord", "tag").agg(F.collect_list("place").alias("places"))
    return removed(joined(marked, listed, all_places, "left"), length)
