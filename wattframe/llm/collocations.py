"""Phrase collocations from count streams in prefix and suffix order.

Texts are lower-cased (A to Z), cut into pieces at punctuation and line breaks, and pieces into words.
Every place gives one window of up to five words, cut at the end of its piece.  Windows are
sorted inside bounded chunks, equal ones added up, then written, range-partitioned and sorted as one
stream in prefix order.  Windows that begin with the same words are neighbours there, so one pass over the
stream counts the phrases of all lengths at once: a phrase's count is the sum of its run.  Only runs at
the ends of a partition are not whole; they are added up afterwards, a few per partition.

What occurs often enough is kept as two streams, by first words and by last words.  Merge joins in step
with the stream of candidates bring the count of the part left of each cut (prefix order), of the part
right of it (suffix order), and the count of the most frequent extension by a word on either side.
Counts of 64 bits, products as exact decimals.  A phrase inside a longer one that is as frequent has an
extension by one word that is as frequent, as counts cannot grow with the length: one word is enough.

Two lists cut pieces where no candidate can reach across: words, and pairs of neighbours, that are found too
rarely.  Each list is counted over the whole corpus, and broadcast up to a size that is checked; with the list
of words, windows hold numbers of words instead of words.  Beyond that size nothing is cut, more windows are
sorted and the result is the same.

Nulls: a null text is empty; a null lang is ``und``, together with rows that say so; doc_id is not read.
Repeated rows count each.  Empty tables give no rows.  Other columns are ignored, whatever their
names.  A text is one unit: its arrays take about 60 bytes per byte of text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.common import small
from wattframe.session import stored

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 8 << 20
#: Frequent words and frequent pairs up to which each list is broadcast (about 20 and 8 bytes each).
BROADCAST_ROWS = 2_000_000
#: Bits and bytes of a word's number in pairs and in windows.
BITS, WIDTH = 21, 3
#: Between the words of a window: below every byte that a word can hold once escaped.
GAP = "\x00"
ESCAPE = (("\x01", "\x01\x02"), ("\x00", "\x01\x01"))

KIND = np.zeros(256, np.uint8)  # 0: part of a word, 1: between words, 2: between pieces
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts as one array, and the number of the piece that each is in."""
    data = LOWER[np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)]
    kind = KIND[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = np.flatnonzero(first)
    length = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1 - begin
    piece = np.cumsum(kind == 2, dtype=np.int32)[begin]
    offsets = np.append(0, np.cumsum(length)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return words, piece


def escaped(text: str | None) -> bytes:
    text = text or ""
    if "\x00" in text or "\x01" in text:
        for plain, safe in ESCAPE:
            text = text.replace(plain, safe)
    return text.encode()


def plain(phrase: Column) -> Column:
    """Words of a window back as they were, joined by spaces."""
    out = F.replace(phrase, F.lit(GAP), F.lit(" "))
    for bare, safe in reversed(ESCAPE):
        out = F.replace(out, F.lit(safe), F.lit(bare))
    return out


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one lang, a chunk at a time."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in small(batches, 256):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = escaped(text)
            held.setdefault(lang, []).append(data)
            total += len(data) + 1
            if total >= CHUNK:
                yield from held.items()
                held, total = {}, 0
    yield from held.items()


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, a) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in chunks(batches):
            coded = words_of(texts)[0].dictionary_encode()
            counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), coded.dictionary, pa.array(counts.astype(np.int64))],
                ["lang", "phrase", "n"],
            )

    parts = texts_of(docs).mapInArrow(run, "lang string, phrase string, n long")
    return parts.groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different rows of numbers from 0 on (-1: none) and how often each is there."""
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    new = np.append(True, (rows[1:] != rows[:-1]).any(1))[: len(rows)]
    at = np.flatnonzero(new)
    return rows[at], np.diff(np.append(at, len(rows)))


def joined(words: pa.Array, rows: np.ndarray) -> pa.Array:
    """Each row's words, joined; -1 ends a row."""
    parts = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum((rows >= 0).sum(1))).astype(np.int32)), words.take(pa.array(rows[rows >= 0]))
    )
    return pc.binary_join(parts, GAP)


def listed_words(frequent: DataFrame) -> dict[str, pa.Array]:
    """Per lang its frequent words; a word's place is its number."""
    out: dict[str, list[str]] = {}
    for row in frequent.toLocalIterator():
        out.setdefault(row["lang"], []).append(row["phrase"])
    return {lang: pa.array(sorted(words), pa.string()) for lang, words in out.items()}


def numbered_words(words: pa.Array, known: dict[str, pa.Array] | None, lang: str) -> tuple[np.ndarray, pa.Array]:
    """Number of each word (-1: not listed; without a list each word has one) and the words by number."""
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int32)
    if known is None:
        return at, coded.dictionary
    listed = known.get(lang, pa.array([], pa.string()))
    number = pc.fill_null(pc.index_in(coded.dictionary, value_set=listed), -1).to_numpy().astype(np.int32)
    return (number[at] if len(at) else at), listed


def pair_counts(docs: DataFrame, known: Broadcast) -> DataFrame:
    """(lang, pair, a) of neighbouring listed words; a pair is the numbers of its two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in chunks(batches):
            words, piece = words_of(texts)
            ids, _ = numbered_words(words, known.value, lang)
            beside = (ids[:-1] >= 0) & (ids[1:] >= 0) & (piece[:-1] == piece[1:])
            pairs = (ids[:-1][beside].astype(np.int64) << BITS) | ids[1:][beside]
            pair, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(pair), pa.string()), pa.array(pair), pa.array(n.astype(np.int64))],
                ["lang", "pair", "n"],
            )

    parts = texts_of(docs).mapInArrow(run, "lang string, pair long, n long")
    return parts.groupBy("lang", "pair").agg(F.sum("n").alias("a"))


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as bytes, the high byte first; -1 ends a row."""
    some = rows >= 0
    data = rows[some].astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - WIDTH :]
    offsets = np.append(0, np.cumsum(some.sum(1) * WIDTH)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def windows(docs: DataFrame, known: Broadcast | None, pairs: Broadcast | None, longest: int) -> DataFrame:
    """(lang, window, n), added up per chunk: windows of two words or more, or given the pairs, of three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in chunks(batches):
            words, piece = words_of(texts)
            ids, names = numbered_words(words, known.value if known else None, lang)
            # a window goes on as long as the next word is in the piece and follows in no rare pair
            link = (ids[:-1] >= 0) & (ids[1:] >= 0) & (piece[:-1] == piece[1:])
            if pairs is not None:
                at = np.flatnonzero(link)
                own = (ids[at].astype(np.int64) << BITS) | ids[at + 1]
                often = pairs.value.get(lang, np.zeros(0, np.int64))
                place = np.minimum(np.searchsorted(often, own), max(len(often) - 1, 0))
                link[at] = (often[place] == own) if len(often) else False
            n = len(ids)
            wide = np.full((n, longest), -1, np.int32)
            wide[:, 0] = ids
            go = link
            for k in range(1, longest):
                wide[: len(go), k][go] = ids[k:][go]
                go = go[:-1] & link[k:]
            rows, counts = distinct_rows(wide[wide[:, 1 if pairs is None else 2] >= 0])
            for first in range(0, len(rows), 1 << 16):
                some = rows[first : first + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(some), pa.string()),
                        packed(some) if known else joined(names, some).cast(pa.binary()),
                        pa.array(counts[first : first + len(some)].astype(np.int64)),
                    ],
                    ["lang", "window", "n"],
                )

    return texts_of(docs).mapInArrow(run, "lang string, window binary, n long")


def unpacked(window: pa.Array, longest: int) -> np.ndarray:
    """The numbers of packed windows, a row each, -1 after the last."""
    offsets = np.frombuffer(window.buffers()[1], np.int32)[window.offset : window.offset + len(window) + 1].astype(np.int64)
    data = np.frombuffer(window.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, WIDTH).astype(np.int64)
    number = (data << (8 * np.arange(WIDTH)[::-1])).sum(1)
    return spread(number, np.diff(offsets) // WIDTH, longest)


def spread(number: np.ndarray, sizes: np.ndarray, longest: int) -> np.ndarray:
    wide = np.full((len(sizes), longest), -1, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    wide[row, np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]] = number
    return wide


def prefix_counts(stream: DataFrame, longest: int, least: int, known: Broadcast | None = None, shortest: int = 2) -> DataFrame:
    """(lang, phrase, a) of phrases of ``shortest`` words or more, from windows in prefix order.

    Runs inside a partition are whole and leave if they are frequent enough; the first and the
    last run of every length always leave, as they may go on in another partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}  # per length: [lang, phrase, count, is the first run]
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            lang, window, n = (batch.column(i) for i in range(3))
            counts = n.to_numpy()
            langs = lang.dictionary_encode()
            if known:
                wide = unpacked(window, longest)
            else:
                parts = pc.split_pattern(window.cast(pa.string()), GAP)
                words = parts.flatten().dictionary_encode()
                sizes = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                wide = spread(words.indices.to_numpy(), sizes, longest)
            sizes = (wide >= 0).sum(1)
            same = np.append(False, langs.indices.to_numpy()[1:] == langs.indices.to_numpy()[:-1])
            same[1:] &= wide[1:, 0] == wide[:-1, 0]

            def phrase(at: int, m: int) -> tuple[str, str]:
                own = lang[at].as_py()
                names = known.value[own] if known else words.dictionary
                return own, GAP.join(names[int(k)].as_py() for k in wide[at, :m])

            for m in range(2, longest + 1):
                same = same & np.append(False, wide[1:, m - 1] == wide[:-1, m - 1])
                if m < shortest:
                    continue
                valid = sizes >= m
                # rows shorter than m end a run and belong to none
                marks = np.flatnonzero(~same)
                sums = np.add.reduceat(counts, marks)
                long = valid[marks]
                starts, sums = marks[long], sums[long]
                for k in np.flatnonzero((sums >= least) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)):
                    name = phrase(int(starts[k]), m)
                    held = open_.get(m)
                    if held is not None and (held[0], held[1]) == name:
                        held[2] += int(sums[k])
                    else:
                        if held is not None and (held[3] or held[2] >= least):
                            out.append(tuple(held[:3]))
                        open_[m] = [*name, int(sums[k]), held is None]
            if out:
                yield emitted(out)
        if open_:
            yield emitted([tuple(h[:3]) for h in open_.values()])

    def emitted(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.int64())],
            ["lang", "phrase", "n"],
        )

    parts = stream.mapInArrow(run, "lang string, phrase string, n long")
    return parts.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of phrases found ``least`` times or more, and (lang, n) of all words."""
    spark = docs.sparkSession
    counted = stored(word_counts(docs), "words")
    totals = counted.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = counted.filter(F.col("a") >= least)
    known = pairs = None
    parts = [frequent]
    if frequent.count() <= BROADCAST_ROWS:
        known = spark.sparkContext.broadcast(listed_words(frequent))
        often = stored(pair_counts(docs, known).filter(F.col("a") >= least), "pairs")
        if often.count() <= BROADCAST_ROWS:
            listed: dict[str, list[int]] = {}
            for row in often.toLocalIterator():
                listed.setdefault(row["lang"], []).append(row["pair"])
            pairs = spark.sparkContext.broadcast({lang: np.sort(np.array(x, np.int64)) for lang, x in listed.items()})
            parts.append(named_pairs(often, known))
    found = stored(windows(docs, known, pairs, longest), "windows")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = found.repartitionByRange(n, "lang", "window").sortWithinPartitions("lang", "window")
    parts.append(prefix_counts(stream, longest, least, known, 3 if pairs else 2))
    return stored(functools.reduce(DataFrame.unionByName, parts), "phrases"), totals


def named_pairs(often: DataFrame, known: Broadcast) -> DataFrame:
    """(lang, phrase, a) of pairs given by numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = []
            for lang, pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names = known.value[lang]
                named.append(GAP.join((names[pair >> BITS].as_py(), names[pair & ((1 << BITS) - 1)].as_py())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(named, pa.string()), batch.column(2)], ["lang", "phrase", "a"]
            )

    return often.mapInArrow(run, "lang string, phrase string, a long")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with their weakest cut: (lang, phrase, k, a, l, r, n, score)."""
    listed = phrases.withColumn("words", F.split("phrase", GAP)).withColumn("m", F.size("words"))
    candidates = listed.filter("m >= 2")
    part = lambda first, size: F.array_join(F.slice("words", first, size), GAP)
    m, k = F.col("m"), F.col("k")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), m - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", part(F.lit(1), k).alias("first"), part(k + 1, m - k).alias("rest")
    )
    # streams in prefix and in suffix order, read in step with the cuts
    by_first = phrases.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")).hint("merge")
    by_rest = phrases.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")).hint("merge")
    both = cuts.join(by_first, ["lang", "first"]).join(by_rest, ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    above = F.lit(1000).cast("decimal(4,0)") * wide("a") * F.col("n").cast("decimal(15,0)")
    whole = both.withColumn("above", above).withColumn("below", wide("l") * wide("r"))
    whole = whole.withColumn("score", F.expr("above div below"))
    weakest = whole.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")
    )
    return weakest.select("lang", "phrase", "x.*")


def extensions(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): count of the most frequent phrase with one word more on either side."""
    listed = phrases.withColumn("words", F.split("phrase", GAP)).filter(F.size("words") >= 3)
    inner = F.array(
        F.array_join(F.slice("words", 1, F.size("words") - 1), GAP),
        F.array_join(F.slice("words", 2, F.size("words") - 1), GAP),
    )
    return listed.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longer")
    )


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's strongest phrases of 2 to ``longest`` words.

    The score is 1000 a n / (l r), floored, of the weakest cut (ties: the shortest left part); phrases inside
    an equally frequent longer one are left out.  Ranks by score, a (both falling) and phrase.
    """
    phrases, totals = phrase_counts(docs, longest, least)
    strong = scored(phrases, totals).join(extensions(phrases).hint("merge"), ["lang", "phrase"], "left")
    kept = strong.filter(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))
    named = kept.withColumn("phrase", plain(F.col("phrase")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
