"""Collocations, periodic runs and top-k search, held against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm import collocations, periodic, topk_search

SPLIT = re.compile("[^\x20\x09-\x0d]+")


# --- collocations ------------------------------------------------------------------


def mined(rows, longest, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            totals[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        n, found = totals[lang], []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(
                len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in f.items() if b >= least
            ):
                continue
            cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            found.append((" ".join(p), a, l, r, n, score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(found[:top])]
    return Counter(out)


def prose(seed=2):
    draw = random.Random(seed)
    words = ["a", "The", "B\x00c", "d\x01", "é", "Ünd", "x" * 40, "it's", "q\xa0r", "-"]
    out = []
    for i in range(60):
        text = "".join(
            draw.choice(words[: draw.choice([3, 10])]) + draw.choice([" ", " ", "\t ", ", ", ".", "\n", "\x0b"])
            for _ in range(draw.randint(0, 120))
        )
        out.append((draw.choice(["xx", "yy", None, "und"]), text))
    return [*out, ("xx", None), ("xx", ""), (None, " .,; "), *out[:5], ("yy", "a " * 500), ("zz", "one, two")]


@pytest.mark.parametrize("chunk, broadcast, top", [(4 << 20, 10**6, 2000), (300, 0, 7), (300, 30, 2000), (300, 10**6, 2000)])
def test_collocations(spark, monkeypatch, chunk, broadcast, top):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", broadcast)
    rows = prose()
    names = "phrase words window n a k first rest longer rank score".split()
    docs = spark.createDataFrame(rows, "lang string, text string").select("*", *[F.lit("x").alias(c) for c in names])
    got = collocations.collocations(docs.repartition(4), least=12, top=top).collect()
    assert Counter(map(tuple, got)) == mined(rows, 5, 12, top)


def test_collocations_of_nothing(empty, docs):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs.filter("doc_id in (1000, 1001)")).count() == 0


def test_runs_at_the_ends_of_partitions_are_added_up(spark):
    """Cut anywhere, the stream gives the same counts."""
    draw = random.Random(5)
    rows = sorted(
        ("xx", collocations.GAP.join(draw.choice("ab") for _ in range(draw.randint(2, 5))), draw.randint(1, 9))
        for _ in range(300)
    )
    want = Counter()
    for _, window, n in rows:
        w = window.split(collocations.GAP)
        for m in range(2, len(w) + 1):
            want[collocations.GAP.join(w[:m])] += n
    for parts in (1, 3, 17):
        cuts = [rows[i * 300 // parts : (i + 1) * 300 // parts] for i in range(parts)]
        rdd = spark.sparkContext.parallelize(cuts, parts).flatMap(lambda x: x)
        stream = spark.createDataFrame(rdd, "lang string, window string, n long").withColumn("window", F.col("window").cast("binary"))
        got = {r.phrase: r.a for r in collocations.prefix_counts(stream, 5, 30).collect()}
        assert got == {p: n for p, n in want.items() if n >= 30}


# --- periodic runs -----------------------------------------------------------------


def runs_of(w, least=12):
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            e = i + q
            seg = w[s:e]
            if e - s >= max(least, 2 * q) and all(seg[r:] != seg[: len(seg) - r] for r in range(1, q)):
                out.add((s, e - s, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = SPLIT.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_of(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (
        doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest(),
    )


def test_runs_are_those_of_brute_force():
    draw = random.Random(1)
    for _ in range(600):
        least, texts = draw.choice([2, 5, 12]), []
        for _ in range(draw.randint(1, 4)):
            w = [draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(draw.randint(0, 70))]
            if w and draw.random() < 0.6:
                p = draw.randint(1, len(w))
                w = [w[i % p] for i in range(len(w))]
                w[draw.randrange(len(w))] = draw.randrange(3)
            texts.append(w)
        codes = np.array([10 * k + x for k, w in enumerate(texts) for x in w], np.int64)
        start, end, period = periodic.runs(codes, least)
        got = list(zip(start.tolist(), (end - start).tolist(), period.tolist()))
        want, at = [], 0
        for w in texts:
            want += [(s + at, length, q) for s, length, q in runs_of(w, least)]
            at += len(w)
        assert got == want


@pytest.mark.parametrize("group, step", [(1 << 17, 1 << 20), (50, 64)])
def test_periodic_runs(spark, raw, monkeypatch, group, step):
    monkeypatch.setattr(periodic, "GROUP", group)
    monkeypatch.setattr(periodic, "STEP", step)
    draw = random.Random(8)
    rows = [(r[0], r[1]) for r in raw]
    rows += [(2000 + i, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 90)))) for i in range(120)]
    rows += [(5000, "x\ty " * 40 + "é " * 30), (5001, "one " * 12), (5002, "one " * 11), (None, "z " * 50), (5003, "\x0b")]
    names = "runs collapsed n_words best start length period h".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in names])
    got = periodic.periodic_runs(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(expected(*r) for r in rows)


def test_periodic_runs_of_nothing(empty):
    assert periodic.periodic_runs(empty).count() == 0


def test_a_long_text_of_one_word_ends_soon():
    start, end, period = periodic.runs(np.zeros(150_000, np.int64))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [150_000], [1])


# --- top-k -------------------------------------------------------------------------


def nearest(rows, k):
    usable = [
        (i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows
        if v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = Counter()
    for a, (query, v) in enumerate(usable):
        if query is None or query % 50:
            continue
        found = [
            (-sum(x * y for x, y in zip(v, w)), other is None, other or 0, other)
            for b, (other, w) in enumerate(usable) if b != a and len(w) == len(v)
        ]
        out.update((query, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(found)[:k]))
    return out


def vectors():
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(9, 24))
    x = [list(map(float, centres[i % 9] + draw.normal(size=24) * draw.choice([0.02, 0.4, 2]))) for i in range(260)]
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(300 + i, x[0]) for i in range(101)] + [(0, x[0]), (0, x[0]), (50, x[3]), (None, x[50]), (None, x[0])]
    rows += [(450, None), (500, [1.0, None]), (550, [float("nan")] * 24), (600, [float("-inf")] * 24), (650, []), (651, [])]
    rows += [(700, [1.0, 2.0]), (701, [2.0, 4.0]), (750, [3.0] * 7), (800, [0.0] * 24), (850, [-2e6] * 24), (851, [2e6] * 24)]
    return [*rows, (-100, [0.5] * 24)]


@pytest.mark.parametrize("block, chunk, tile", [(16_384, 32_768, (512, 2048)), (20, 4, (3, 7))])
def test_top_k(spark, monkeypatch, block, chunk, tile):
    monkeypatch.setattr(topk_search, "TILE", tile)
    rows = vectors()
    names = "v ids block chunk side bar size sketch score place nth own".split()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(
        "*", *[F.lit("x").alias(c) for c in names]
    )
    got = topk_search.top_k(df.repartition(3), block_rows=block, chunk=chunk).collect()
    assert Counter(map(tuple, got)) == nearest(rows, 5)


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(none).count() == 0
    unasked = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk_search.top_k(unasked).count() == 0


def test_segments_bound_the_product():
    draw = np.random.default_rng(2)
    for size in (1, 2, 5, 24, 64):
        a, b = draw.integers(-300, 300, (40, size)), draw.integers(-300, 300, (50, size))
        exact, before = a @ b.T, None
        for segments in topk_search.LEVELS:
            bound = topk_search.statistics(a, segments) @ topk_search.statistics(b, segments).T
            assert (bound >= exact - 1e-6).all()
            assert before is None or (bound <= before + 1e-6).all()  # finer is tighter
            before = bound
