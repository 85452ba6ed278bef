"""Quality scores and thresholds, and the language model's training, held against plain Python."""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from wattframe.llm import langid, quality


# --- quality -----------------------------------------------------------------------


def bucket(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64(w.encode(), seed=seed).intdigest()
    signed = seed - 2**64 if seed >= 2**63 else seed
    return signed % quality.BUCKETS


def grams(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    return [bucket(x) for x in w] + [bucket(a, b) for a, b in zip(w, w[1:])]


def labelled_corpus(n=260):
    draw = random.Random(3)
    docs = []
    for i in range(n):
        letter = draw.choice("gbm")
        docs.append((i, " ".join(f"{draw.choice(letter + 'x')}{draw.randint(0, 60)}" for _ in range(draw.randint(30, 160)))))
    docs += [(n, None), (n + 1, ""), (n + 2, "one"), (None, "no id"), (0, "an id again " * 20)]
    labels = [(i, int(docs[i][1].count("g") > docs[i][1].count("b")), draw.choice([0, 0, 1, None])) for i in range(0, n, 2)]
    return docs, [*labels, labels[0], (4, 0, 0), (4, 1, 0), (None, 1, 0), (6, None, 1), (n + 2, 1, 0)]


@pytest.mark.parametrize("rows", [20_000, 7])
def test_scores_and_threshold(spark, rows):
    docs, labels = labelled_corpus()
    names = "b x score kept _ratios good target bin words".split()
    table = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in names])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(0))
    got = quality.judge(table.repartition(3), marks, rows).collect()
    assert len(got) == len(docs)

    import hashlib

    pairs = {}
    for i, good, toxic in labels:
        if i is not None and good is not None:
            pairs.setdefault((i, good == 1), []).append(toxic or 0)
    order = lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)
    trusted = sorted((i for (i, good), t in pairs.items() if good and not max(t) and zlib.crc32(str(i).encode()) % 2 == 0), key=order)
    trusted = set(trusted[:rows])
    good, every = Counter(), Counter()
    for i, text in docs:
        every.update(grams(text))
        if i in trusted:
            good.update(grams(text))
    n = quality.BUCKETS
    ratio = [
        math.log((good[b] + 1) / (sum(good.values()) + n)) - math.log((every[b] + 1) / (sum(every.values()) + n))
        for b in range(n)
    ]
    score = lambda text: sum(ratio[b] for b in grams(text)) / len(grams(text)) if grams(text) else 0.0
    want = Counter((i, round(score(t), 9)) for i, t in docs)
    assert Counter((r.doc_id, round(r.score, 9)) for r in got) == want
    lists = {True: [], False: []}
    for r in got:
        for (i, is_good) in pairs:
            if i == r.doc_id and not r.base_failed and not (is_good and i in trusted):
                lists[is_good].append(r.score)
    low = np.quantile(lists[True], quality.BELOW)
    high = np.quantile(lists[False], 1 - quality.ABOVE)
    cut = low - max(low - high, 0) / 2
    assert all(r.kept == (not r.base_failed and r.score >= cut - 1e-12) for r in got)
    assert 0 < sum(r.kept for r in got) < len(got)


@pytest.mark.parametrize("bins", [3, 50, 4096])
def test_order_statistics(spark, bins):
    draw = np.random.default_rng(1)
    for values in (draw.normal(size=700), draw.integers(0, 4, 500) / 3, np.append(draw.normal(size=300), [1e12, -1e-9]), [2.5]):
        values = sorted(map(float, values))
        df = spark.createDataFrame([(x,) for x in values], "x double").repartition(3)
        ranks = sorted({0, len(values) - 1, len(values) // 3, len(values) // 2})
        assert quality.order_statistics(df, ranks, bins) == {k: values[k] for k in ranks}
        assert quality.quantile(df, 0.37) == pytest.approx(float(np.quantile(values, 0.37)))
    assert quality.quantile(spark.createDataFrame([], "x double"), 0.5) is None


def test_quality_of_nothing(spark, empty):
    assert quality.judge(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# --- language id -------------------------------------------------------------------


def sample(n=40):
    draw = random.Random(7)
    rows = []
    for i in range(n):
        lang = draw.choice(["aa", "bb", "cc"])
        own = {"aa": range(0, 8), "bb": range(5, 13), "cc": range(10, 18)}[lang]
        found = sorted(draw.sample(list(own), 5))
        rows.append((i, lang, i + 1, found, [draw.randint(1, 6) for _ in found]))
    return pd.DataFrame(rows, columns=["doc_id", "lang", "rank", "buckets", "counts"])


def test_training_is_ftrl_on_tf_idf_with_a_temperature():
    """Coordinate by coordinate, as the update rule is published."""
    s = langid.Settings(bits=5, passes=2)
    frame = sample()
    got = langid.train(frame, s)
    meta = json.loads(got["meta"])
    table = {int(b): r for b, r in zip(np.frombuffer(got["buckets"], np.int32), np.frombuffer(got["weights"]).reshape(-1, 3))}

    rows = list(frame.itertuples(index=False))
    learnt = [r for r in rows if r.rank % s.calibrate_every]
    held = [r for r in rows if r.rank % s.calibrate_every == 0]
    seen = Counter(b for r in learnt for b in r.buckets)
    idf = {b: math.log((1 + len(learnt)) / (1 + c)) + 1 for b, c in seen.items()}
    langs, bias = ["aa", "bb", "cc"], "bias"
    z, n = Counter(), Counter()

    def features(r):
        out = {b: idf.get(b, 0.0) * c * 30.0 / sum(r.counts) for b, c in zip(r.buckets, r.counts)}
        return out | {bias: 1.0}

    def weight(i, k):
        if abs(z[i, k]) <= s.l1:
            return 0.0
        return -(z[i, k] - math.copysign(s.l1, z[i, k])) / ((s.beta + math.sqrt(n[i, k])) / s.alpha + s.l2)

    for _ in range(s.passes):
        for r in learnt:
            x = features(r)
            w = {(i, k): weight(i, k) for i in x for k in langs}
            score = {k: sum(w[i, k] * v for i, v in x.items()) for k in langs}
            total = sum(math.exp(v) for v in score.values())
            for k in langs:
                for i, v in x.items():
                    g = v * (math.exp(score[k]) / total - (k == r.lang))
                    sigma = (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / s.alpha
                    z[i, k] += g - sigma * w[i, k]
                    n[i, k] += g * g
    assert meta["langs"] == langs
    assert meta["bias"] == pytest.approx([weight(bias, k) for k in langs], rel=1e-6, abs=1e-9)
    for b in seen:
        want = [weight(b, k) * idf[b] * 30.0 for k in langs]
        assert list(table.get(b, [0.0] * 3)) == pytest.approx(want, rel=1e-6, abs=1e-9)

    def loss(t):
        total, sure = 0.0, (len(held) + 1) / (len(held) + 2)
        for r in held:
            score = [sum(weight(i, k) * v for i, v in features(r).items()) / t for k in langs]
            log_sum = math.log(sum(map(math.exp, score)))
            for k, v in zip(langs, score):
                total -= (sure if k == r.lang else (1 - sure) / 2) * (v - log_sum)
        return total / len(held)

    steps = [0.05 * (400 ** (i / 120)) for i in range(121)]
    assert meta["temperature"] == pytest.approx(min(steps, key=loss), rel=1e-6)


def test_the_sample_is_bounded_however_often_an_id_comes(spark, monkeypatch):
    rows = [(7, f"text number {i % 300} of one id", "xx") for i in range(900)] + [(i, "och så", "yy") for i in range(30)]
    rows += [(None, "without an id", "xx")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = spark.sparkContext.accumulator(0)
    train = langid.train

    def counted(frame, settings):
        sizes.add(len(frame))
        assert frame.groupby("lang").size().max() <= settings.per_language
        return train(frame, settings)

    monkeypatch.setattr(langid, "train", counted)
    model = langid.fit(docs, langid.Settings(per_language=20, passes=1))
    assert json.loads(model["meta"])["langs"] == ["xx", "yy"] and sizes.value == 40


def test_predictions_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([("hello", "x", 5, "y")], "text string, lang_pred string, score int, rank string")
    out = langid.predict(docs, None)
    assert out.columns == ["text", "rank", "lang_pred", "score"] and tuple(out.first()) == ("hello", "y", "und", 0.0)
