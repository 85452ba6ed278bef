"""Packing documents into sequences by lexical retrieval.

Documents are tokenised; every full window of a document is a sequence of its own, and the rest
of it, its tail, is packed.  Tails are dealt over shards of bounded size by the pivots, a few
of the tails themselves, that BM25 finds most similar to them, so that like tails meet.  Each
shard has a BM25 index over the token ids of its tails, with document frequencies and the mean
length of the whole corpus; a seed, with all its terms, retrieves the most similar unused tails,
which fill its window greedily.  The last one is cut where the window ends and its rest stays
in the shard, so at most one sequence per shard has padding.  Seeds do not look into other
shards.

A null or empty text is the closing token alone.  Texts are tokenised whole.  Equal rows are
packed each on its own.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import small
from wattframe.session import stored

WINDOW = 1024
#: Tails per shard, pivots by which they are dealt and how many of them name a cell, most
#: frequent terms whose scores are one matrix product, BM25's constants.
SHARD_ROWS, PIVOTS, NEAREST, HOT, K1, B = 4096, 64, 3, 256, 1.2, 0.75
#: Numbers of token ids: they fit 16 bits.  Seeds whose products are made at once.
IDS, BLOCK = 1 << 16, 128
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

# Characters on which both tokenisers split alike; any other text takes the slower one.
_PLAIN = re.compile("[^\x00-ɏ‐-‧€]")
#: Letters in a row above which the faster tokeniser's merges get slow.
_RUN, _LONG = 2000, 20_000


@functools.cache
def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    out.encode_special_tokens = True
    return out


@functools.cache
def _ranked():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str) -> np.ndarray:
    """Token ids of a text.  The same vocabulary is read by two libraries; the faster one takes
    the texts on which they agree."""
    long_run = len(text) > _LONG and max(map(len, re.split(r"(\s+)", text))) > _RUN
    if long_run or "<|" in text or _PLAIN.search(text):
        return np.array(_tokenizer().encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(_ranked().encode_ordinary(text), np.uint32)


def tokenised(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_tokens, crcs, tail): checksums of the full windows, ids of what is left."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("tail", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            tokens, crcs, tails = [], [], []
            for text in batch.column("text").to_pylist():
                ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                full = len(ids) // window * window
                tokens.append(len(ids))
                crcs.append([zlib.crc32(ids[i : i + window].tobytes()) for i in range(0, full, window)])
                # ids of this vocabulary fit 16 bits
                tails.append(ids[full:].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(tokens, pa.int64()),
                    pa.array(crcs, pa.list_(pa.int64())),
                    pa.array(tails, pa.binary()),
                ],
                schema=schema,
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, n_tokens long, crcs array<long>, tail binary")


class Corpus:
    """What BM25 takes from all tails: the weight of each term and the mean length."""

    def __init__(self, n: int, df: np.ndarray, mean: float):
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.mean = mean

    @classmethod
    def of(cls, tails: list[np.ndarray]) -> "Corpus":
        df = np.zeros(IDS, np.int64)
        for t in tails:
            df[np.unique(t)] += 1
        return cls(len(tails), df, float(np.mean([len(t) for t in tails])) if tails else 1.0)

    def weight(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))


class Index:
    """BM25 over the token ids of tails; knows which are still unused."""

    def __init__(self, tails: list[np.ndarray], corpus: Corpus | None = None):
        n = len(tails)
        corpus = corpus or Corpus.of(tails)
        sizes = np.array([len(t) for t in tails], np.int64)
        counted = [np.unique(t, return_counts=True) for t in tails]
        term = np.concatenate([t for t, _ in counted] or [np.zeros(0, np.uint16)])
        tf = np.concatenate([c.astype(np.float32) for _, c in counted] or [np.zeros(0, np.float32)])
        doc = np.repeat(np.arange(n), [len(t) for t, _ in counted])
        del counted
        order = np.argsort(term, kind="stable")
        term, tf, self.doc = term[order], tf[order], doc[order]
        del order, doc
        self.starts = np.searchsorted(term, np.arange(IDS + 1))
        # as the sums below take them, or every seed would convert its lists
        self.weight = corpus.weight(term, tf, sizes[self.doc])
        del tf
        # the most frequent terms have most postings: their part of scores is a matrix product
        df = np.diff(self.starts)
        hot = np.argsort(-df, kind="stable")[:HOT]
        self.rare = np.ones(IDS, bool)
        self.rare[hot] = False
        column = np.full(IDS, -1)
        column[hot] = np.arange(len(hot))
        at = np.flatnonzero(column[term] >= 0)
        asked, given = np.zeros((n, len(hot)), np.float32), np.zeros((n, len(hot)), np.float32)
        asked[self.doc[at], column[term[at]]] = 1
        given[self.doc[at], column[term[at]]] = self.weight[at]
        self.asked, self.given = asked, given
        self.begin, self.frequent = 0, np.zeros((0, n), np.float32)
        self.unused = sizes > 0
        self.tails, self.n = tails, n

    def ahead(self, seed: int) -> None:
        """Have the products of the block of seeds that this one, taken in turn, stands in."""
        if not self.begin <= seed < self.begin + len(self.frequent):
            self.begin = seed // BLOCK * BLOCK
            self.frequent = self.asked[self.begin : self.begin + BLOCK] @ self.given.T

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all tails for all terms of one."""
        terms = np.unique(self.tails[seed]).astype(np.int64)
        terms = terms[self.rare[terms]]
        first, length = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        take = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
        known = self.begin <= seed < self.begin + len(self.frequent)
        frequent = self.frequent[seed - self.begin] if known else self.given @ self.asked[seed]
        return frequent + np.bincount(self.doc[take], weights=self.weight[take], minlength=self.n)

    def nearest(self, seed: int, wanted: int = 32) -> np.ndarray:
        """Unused tails most similar to a seed, best first; those that share no term last."""
        score = self.scores(seed)
        score[~self.unused] = -1
        some = min(wanted, self.n)
        best = np.argpartition(-score, some - 1)[:some]
        best = best[np.lexsort((best, -score[best]))]
        return best[score[best] >= 0]

    def neighbours(self, ids: np.ndarray, wanted: int = 32) -> np.ndarray:
        """The same for a tail given by its ids, which is one of the index."""
        return self.nearest(next(i for i, t in enumerate(self.tails) if np.array_equal(t, ids)), wanted)


def fill(tails: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (tail, begin, end) that hold every id once."""
    index = Index(tails, corpus)
    begin = np.zeros(len(tails), np.int64)
    sizes = np.array([len(t) for t in tails])
    for seed in range(len(tails)):
        if not index.unused[seed]:
            continue
        index.unused[seed] = False
        index.ahead(seed)
        sequence, room = [(seed, int(begin[seed]), int(sizes[seed]))], window - int(sizes[seed] - begin[seed])
        while room > 0:
            # the seed asks again if all that it was given fits
            found = index.nearest(seed)
            if not len(found):
                break
            skipped = None
            for i in found:
                left = int(sizes[i] - begin[i])
                if left <= room:
                    sequence.append((int(i), int(begin[i]), int(sizes[i])))
                    index.unused[i] = False
                    room -= left
                    if not room:
                        break
                elif skipped is None:
                    skipped = int(i)
            if room and skipped is not None:
                end = int(begin[skipped]) + room
                sequence.append((skipped, int(begin[skipped]), end))
                begin[skipped] = end
                room = 0
        yield sequence


def corpus_of(pieces: DataFrame) -> Corpus:
    """Document frequencies, number and mean length of all tails; one row per term leaves a
    task's batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, tails, total = np.zeros(IDS, np.int64), 0, 0
        for batch in batches:
            for tail in batch.column("tail").to_pylist():
                ids = np.frombuffer(tail, "<u2")
                df[np.unique(ids)] += 1
                tails, total = tails + 1, total + len(ids)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(term, [-1, -2])), pa.array(np.append(df[term], [tails, total]))], ["term", "n"]
        )

    counted = pieces.select("tail").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    known = {r["term"]: r["n"] for r in counted.collect()}
    n, total = known.pop(-1, 0), known.pop(-2, 0)
    df = np.zeros(IDS, np.int64)
    df[list(known)] = list(known.values())
    return Corpus(n, df, total / max(n, 1) or 1.0)


def dealt(pieces: DataFrame, corpus: Corpus, shard_rows: int) -> DataFrame:
    """``pieces`` with their shard.  A tail's cell is the row of its nearest pivots; shards are
    made of cells in order, and a cell over the size of a shard is cut by a hash of its rows'
    numbers, so that equal rows part too."""
    hashed = F.xxhash64("tail")
    first = pieces.filter(F.length("tail") > 2).select("tail", hashed.alias("h")).orderBy("h", "tail")
    chosen = sorted({bytes(r["tail"]) for r in first.limit(4 * PIVOTS).collect()}, key=zlib.crc32)[:PIVOTS]
    table = np.zeros((IDS, max(len(chosen), 1)), np.float32)
    for i, tail in enumerate(chosen):
        term, tf = np.unique(np.frombuffer(tail, "<u2"), return_counts=True)
        table[term, i] = corpus.weight(term, tf, np.full(len(term), len(tail) // 2))
    broadcast = pieces.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int64)
            for i, tail in enumerate(batch.column("tail").to_pylist()):
                score = broadcast.value[np.unique(np.frombuffer(tail, "<u2"))].sum(axis=0)
                for near in np.argsort(-score, kind="stable")[:NEAREST]:
                    cells[i] = cells[i] * PIVOTS + near
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

    schema = "doc_id long, n_tokens long, crcs array<long>, tail binary, cell long"
    placed = stored(pieces.mapInArrow(run, schema), "cells")
    # PIVOTS ** NEAREST rows at most
    counts = sorted((r["cell"], r["count"]) for r in placed.groupBy("cell").count().collect())
    begin, parts = np.zeros(PIVOTS**NEAREST, np.int64), np.ones(PIVOTS**NEAREST, np.int64)
    shard, held = 0, 0
    for cell, count in counts:
        if held and held + count > shard_rows:
            shard, held = shard + 1, 0
        begin[cell], parts[cell] = shard, -(-count // shard_rows)
        held += count
        if parts[cell] > 1:
            shard, held = shard + int(parts[cell]), 0
    known = pieces.sparkSession.createDataFrame(
        [(c, int(begin[c]), int(parts[c])) for c, _ in counts], "cell long, begin long, parts long"
    )
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts"))
    return placed.join(F.broadcast(known), "cell").withColumn("shard", F.col("begin") + part).drop("cell", "begin", "parts")


def pack(docs: DataFrame, window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    pieces = stored(tokenised(docs, window), "tokens")
    corpus = corpus_of(pieces)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        base = key[0].as_py() << 32
        rows = table.to_pylist()
        rows.sort(key=lambda r: (zlib.crc32(r["tail"]), r["tail"], r["n_tokens"], str(r["doc_id"])))
        out, sequence = [], base
        for r in rows:
            for i, crc in enumerate(r["crcs"]):
                out.append((r["doc_id"], i * window, window, crc, r["n_tokens"], sequence, 0))
                sequence += 1
        tails = [np.frombuffer(r["tail"], "<u2") for r in rows]
        for parts in fill(tails, window, corpus):
            offset = 0
            for i, begin, end in parts:
                r = rows[i]
                crc = zlib.crc32(tails[i][begin:end].astype("<u4").tobytes())
                start = len(r["crcs"]) * window + begin
                out.append((r["doc_id"], start, end - begin, crc, r["n_tokens"], sequence, offset))
                offset += end - begin
            sequence += 1
        columns = list(zip(*out)) if out else [()] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names)

    schema = ", ".join(f"`{n}` long" for n in names)
    return dealt(pieces, corpus, shard_rows).groupBy("shard").applyInArrow(run, schema)
