"""Language identification: logistic regression on TF-IDF weighted character n-grams.

Texts are lower-cased, everything but letters becomes a space, and n-grams of one to three
characters are hashed.  Weights come from follow-the-regularised-leader with elastic-net
penalties, so most of them are exactly zero; a temperature fitted on labelled documents that
training never saw turns scores into probabilities.

The fit reads a bounded sample of labelled documents (``Settings.per_language`` each, the first
in the order of a hash of doc_id, ties by a hash of the text; rows that repeat count once); prediction reads
every text whole, long ones in steps.  A null text, or one without letters, is ``und`` with score 0, and so is
everything if nothing is labelled.  Rows are predicted one by one, so equal rows agree; of equal scores the first
language by name wins.  An empty table gives no rows.  ``predict`` passes other columns on, and replaces those
that have the names of the two it adds; ``identify`` ignores other columns.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.common import small
from wattframe.session import stored

UNKNOWN = "und"
#: Documents in the sample up to which their keys are broadcast to the texts (40 bytes each).
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """Sample bound and training constants."""

    per_language: int = 600
    bits: int = 16
    longest: int = 3
    passes: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    #: One in so many sampled documents is kept for the temperature.
    calibrate_every: int = 5


#: Codes per step of the vector work; bounds its memory whatever the length of a text.
STEP = 1 << 18


@functools.cache
def letters() -> np.ndarray:
    """For each code point itself if it is a letter, else a space."""
    codes = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            codes[c] = c
    return codes


def groups(texts: list[str]) -> Iterator[list[int]]:
    """Indexes of texts that together stay near one step; a longer text is alone."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if group and size + len(t) > STEP:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(t) + 2
    if group:
        yield group


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each between spaces, and where each begins."""
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32)
    starts = np.cumsum([0] + [len(t) for t in padded])[:-1]
    return letters()[codes], starts


def grams(codes: np.ndarray, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length: the bucket of the n-gram at each position, and where there is one.

    N-grams do not begin with two spaces, so none reaches into the next text.
    """
    shift = np.uint32(32 - settings.bits)
    state = codes * np.uint32(2654435761)
    usable = codes != 32
    for n in range(1, settings.longest + 1):
        if n > 1:
            state = (state[:-1] ^ codes[n - 1 :]) * np.uint32(2246822519 + 2 * n)
            usable = (codes[:-1] != 32) | (codes[1:] != 32)
            usable = usable[: len(state)]
        yield (state ^ (state >> np.uint32(15))) >> shift, usable


def windows(codes: np.ndarray, longest: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Begin, end and codes (with what the last n-grams need) of bounded stretches."""
    for begin in range(0, len(codes), STEP):
        end = min(begin + STEP, len(codes))
        yield begin, end, codes[begin : end + longest - 1]


def counts(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    total = np.zeros(1 << settings.bits, np.int64)
    codes, _ = coded([text])
    for begin, end, part in windows(codes, settings.longest):
        for bucket, usable in grams(part, settings):
            keep = slice(0, end - begin)
            total += np.bincount(bucket[keep][usable[keep]], minlength=len(total))
    found = np.flatnonzero(total)
    return found, total[found]


def train(frame: pd.DataFrame, settings: Settings) -> dict:
    """The model of a sample of (lang, rank, buckets, counts)."""
    frame = frame.sort_values(["rank", "lang", "doc_id"], na_position="first")
    langs = sorted(frame["lang"].unique())
    place = {x: i for i, x in enumerate(langs)}
    size = (1 << settings.bits) + 1  # the last is the constant term
    held = (frame["rank"] % settings.calibrate_every == 0).to_numpy()
    if held.all():
        held[:] = False
    y = frame["lang"].map(place).to_numpy()
    rows = [
        (np.asarray(b, np.int64), np.asarray(c, np.float64))
        for b, c in zip(frame["buckets"], frame["counts"])
    ]
    seen = np.zeros(size)
    for (bucket, _), out in zip(rows, held):
        if not out:
            seen[bucket] += 1
    idf = np.log((1 + (~held).sum()) / (1 + seen)) + 1
    idf[seen == 0] = 0

    def vector(bucket, count):
        x = idf[bucket] * count * (30.0 / max(count.sum(), 1))
        return np.append(bucket, size - 1), np.append(x, 1.0)

    z, n = np.zeros((size, len(langs))), np.zeros((size, len(langs)))

    def weights(at):
        strength = (settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - settings.l1, 0)
        return -shrunk / strength

    vectors = [vector(*r) for r in rows]
    for _ in range(settings.passes):
        for (at, x), label, out in zip(vectors, y, held):
            if out:
                continue
            w = weights(at)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / settings.alpha * w
            n[at] += g * g
    w = weights(np.arange(size))
    check = [(x @ w[at], label) for (at, x), label, out in zip(vectors, y, held) if out]
    temperature = 1.0
    if check and len(langs) > 1:
        s, label = np.array([c[0] for c in check]), np.array([c[1] for c in check])
        # labels count as sure only as far as their number allows, so the optimum is finite
        sure = np.full(s.shape, 1 / (len(s) + 2) / (len(langs) - 1))
        sure[np.arange(len(s)), label] = (len(s) + 1) / (len(s) + 2)

        def loss(t):
            v = s / t
            v = v - v.max(1, keepdims=True)
            return -(sure * (v - np.log(np.exp(v).sum(1, keepdims=True)))).sum(1).mean()

        temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    used = np.flatnonzero((w[:-1] != 0).any(1))
    table = (w[used] * idf[used, None] * 30.0).astype(np.float64)
    return {
        "meta": json.dumps({"langs": langs, "temperature": temperature, "bias": w[-1].tolist()}),
        "buckets": used.astype(np.int32).tobytes(),
        "weights": table.tobytes(),
    }


def fit(docs: DataFrame, settings: Settings = Settings()) -> dict | None:
    """The model for rows of (doc_id, text, lang), or None if there are none.

    The sample is chosen on narrow columns; only its texts are then read.  Features are made
    where the texts are; one task trains on them, its input bounded by the settings.
    """
    spark = docs.sparkSession
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.xxhash64("text").alias("content")
    )
    # an id may repeat with other texts: each different text is a document of its own
    key = ["doc_id", "lang", "content"]
    marked = usable.select(*key, mark.alias("mark")).distinct()
    # first per language and first digit of the hash, so that a language never meets whole
    few = Window.partitionBy("lang", F.substring("mark", 1, 1)).orderBy("mark", "doc_id", "content")
    order = Window.partitionBy("lang").orderBy("mark", "doc_id", "content")
    chosen = marked
    for window in (few, order):
        chosen = chosen.withColumn("rank", F.row_number().over(window)).filter(
            F.col("rank") <= settings.per_language
        )
    chosen = stored(chosen.select(*[F.col(c).alias(f"_{c}") for c in key], "rank"), "sample")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    same = functools.reduce(lambda x, y: x & y, [usable[c].eqNullSafe(chosen[f"_{c}"]) for c in key])
    # rows that repeat are one
    texts = usable.join(chosen, same).groupBy("doc_id", "lang", "rank").agg(F.first("text").alias("text"))
    schema = "doc_id long, lang string, rank int, buckets array<int>, counts array<int>"

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for row in batch.to_pylist():
                bucket, count = counts(row.pop("text"), settings)
                row |= {"buckets": bucket.tolist(), "counts": count.tolist()}
                yield pa.RecordBatch.from_pylist([row], out_schema)

    out_schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("lang", pa.string()), ("rank", pa.int32()),
            ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())),
        ]
    )

    def trained(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([train(frame, settings)])

    model = (
        texts.select("doc_id", "lang", "rank", "text")
        .mapInArrow(featured, schema)
        .groupBy(F.lit("all"))
        .applyInPandas(trained, "meta string, buckets binary, weights binary")
        .collect()
    )
    return model[0].asDict() if model else None


def loaded(model: dict, settings: Settings) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, bias and one full column of weights per language, at temperature 1."""
    meta = json.loads(model["meta"])
    langs, t = meta["langs"], meta["temperature"]
    table = np.zeros((len(langs), 1 << settings.bits))
    at = np.frombuffer(model["buckets"], np.int32)
    table[:, at] = np.frombuffer(model["weights"]).reshape(len(at), len(langs)).T / t
    return langs, np.array(meta["bias"]) / t, table


def scores(
    texts: list[str], bias: np.ndarray, table: np.ndarray, settings: Settings
) -> tuple[np.ndarray, np.ndarray]:
    """Per text: one number per language, and whether it has a letter."""
    codes, starts = coded(texts)
    sums = np.zeros((len(texts), len(bias)))
    total, lettered = np.zeros(len(texts)), np.zeros(len(texts), bool)
    for begin, end, part in windows(codes, settings.longest):
        first = int(np.searchsorted(starts, begin, "right")) - 1
        last = int(np.searchsorted(starts, end, "left"))
        cuts = np.maximum(starts[first:last] - begin, 0)
        lettered[first:last] |= np.add.reduceat((part[: end - begin] != 32).astype(np.int64), cuts) > 0
        for bucket, usable in grams(part, settings):
            size = min(end - begin, len(bucket))
            inside = cuts < size
            at, rows = cuts[inside], slice(first, first + int(inside.sum()))
            keep = usable[:size]
            total[rows] += np.add.reduceat(keep.astype(np.int64), at)
            bucket = bucket[:size]
            for k, column in enumerate(table):
                sums[rows, k] += np.add.reduceat(np.where(keep, column[bucket], 0.0), at)
    return sums / np.maximum(total, 1)[:, None] + bias, lettered


def predict(
    docs: DataFrame,
    model: dict | None,
    settings: Settings = Settings(),
    names_added: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``docs`` (any columns, with ``text``) with the language and its probability added."""
    docs = docs.drop(*names_added)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"{_ddl(docs)}, `{names_added[0]}` string, `{names_added[1]}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = loaded(shared.value, settings) if shared.value else None
        for batch in small(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for group in groups(texts) if parts else ():
                langs, bias, table = parts
                s, lettered = scores([texts[i] for i in group], bias, table, settings)
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                top = p.argmax(1)
                for j, i in enumerate(group):
                    if lettered[j]:
                        names[i], best[i] = langs[top[j]], min(1.0, float(p[j, top[j]]))
            added = [pa.array(names, pa.string()), pa.array(best, pa.float64())]
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(
                [c for _, c in kept] + added, [n for n, _ in kept] + list(names_added)
            )

    return docs.mapInArrow(run, schema)


def _ddl(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Documents that training never sees."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fits on the labelled documents that are not held out, predicts all: the query's rows."""
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out()), settings)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    predicted = predict(texts, model, settings)
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
