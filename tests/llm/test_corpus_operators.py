"""Operators across documents, held against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.llm import graph, ngram_join, packing, suffix_dedup, vector_join


def grouped(links: dict, ids: dict) -> dict:
    """Smallest id reachable."""
    out = {}
    for x in links:
        seen, todo = {x}, [x]
        while todo:
            for y in links[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        known = [ids[y] for y in seen if ids[y] is not None]
        out[x] = min(known) if known else None
    return out


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (20, 21)] + [(100, i) for i in range(101, 160)]
    edges += [(i, i + 1) for i in range(200, 240)] + [(5, 5)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[9] == 6 and got[159] == 100 and got[240] == 200 and got[21] == 20
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("cell", [200_000, 300])
def test_ngram_join(docs, raw, clashing, monkeypatch, cell):
    monkeypatch.setattr(ngram_join, "CELL", cell)
    sets = {k: shingles(r[1]) for k, r in enumerate(raw)}
    links = {
        a: [b for b in sets if a != b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])] for a in sets
    }
    least = grouped(links, {k: r[0] for k, r in enumerate(raw)})
    want = Counter((raw[k][0], len(links[k]), least[k]) for k in sets)
    got = ngram_join.near_duplicates(clashing).collect()
    assert Counter((r.doc_id, r.n_links, r.class_id) for r in got) == want


def one_per_class(raw):
    """Rows that stay, as (id, text): by brute force, without a look at ids but for the order."""
    sets = [shingles(r[1]) for r in raw]
    n, out, seen = len(raw), Counter(), set()
    for a in range(n):
        if a in seen:
            continue
        group, todo = {a}, [a]
        while todo:
            x = todo.pop()
            near = [y for y in range(n) if y not in group and sets[x] and 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y])]
            group.update(near)
            todo += near
        seen |= group
        first = min((raw[x][0] is None, raw[x][0] or 0) for x in group)
        out[(None if first[0] else first[1], frozenset(raw[x][1] for x in group if (raw[x][0] is None, raw[x][0] or 0) == first))] += 1
    return out


def test_one_row_of_each_class_stays(spark, raw):
    long = lambda w: " ".join(f"{w}{i}" for i in range(40))
    odd = [(1, long("a")), (1, long("b")), (2, long("c")), (3, long("a")), (2, long("d") + " x"), (9, long("d")), (1, long("d"))]
    odd += [(None, long("e")), (None, long("e")), (None, long("f")), (None, long("f") + " y"), (7, None), (7, None), (7, " ")]
    odd += [(8, long("g"))] * 3 + [(0, long("a") + " z"), (None, None)]
    for rows in (odd, [(r[0], r[1]) for r in raw]):
        names = "node root copies nth first_id _kept_id _kept_rows _node".split()
        table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _x int")
        table = table.select("*", *[F.lit("x").alias(c) for c in names])
        out = ngram_join.deduplicate(table.repartition(3))
        assert out.columns == table.columns
        left, want = Counter((r.doc_id, r.text) for r in out.collect()), one_per_class(rows)
        assert sum(left.values()) == sum(want.values())
        for (doc, text), times in left.items():
            assert times == sum(n for (d, texts), n in want.items() if d == doc and text in texts), (doc, text)


def test_ngram_join_of_nothing(empty):
    assert ngram_join.near_duplicates(empty).count() == 0


def test_bands_reach_the_recall():
    bands, rows = ngram_join.banding(0.8, 0.99999, 6)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_window_hashes_do_not_depend_on_neighbours():
    a, b = b"one two three four five six seven", b"x y"
    both, offsets, n = ngram_join.windows([b, a, b"", a])
    alone, _, _ = ngram_join.windows([a])
    assert list(n) == [2, 7, 0, 7] and list(both[offsets[1] : offsets[1] + 3]) == list(alone) == list(both[offsets[3] :])


@pytest.mark.parametrize("interval, most", [(1 << 20, 16), (4096, 16), (400, 16), (400, 2)])
def test_vectors(spark, monkeypatch, interval, most):
    monkeypatch.setattr(vector_join, "INTERVAL_BYTES", interval)
    monkeypatch.setattr(vector_join, "GROUPED", most)
    monkeypatch.setattr(vector_join, "LEAF", 16)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 24))
    x = [list(map(float, centres[i % 12] + draw.normal(size=24) * draw.choice([0.05, 0.3]))) for i in range(150)]
    x += [x[0], x[1], None, [], [0.0] * 24, [1.0, None] * 12, [float("nan")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [3.0] * 24]
    rows = [(i, v, "x") for i, v in enumerate(x)] + [(0, x[0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")

    def near(a, b):
        if not a or not b or len(a) != len(b):
            return False
        if any(None in v or not np.isfinite(v).all() or not np.any(v) for v in (a, b)):
            return False
        return float(np.dot(a, b) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(b, b))) >= 0.9

    links = {i: [j for j in range(len(rows)) if i != j and near(rows[i][1], rows[j][1])] for i in range(len(rows))}
    least = grouped(links, {i: r[0] for i, r in enumerate(rows)})
    got = vector_join.near_duplicates(df).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(
        (rows[i][0], len(links[i]), least[i]) for i in links
    )
    none = vector_join.near_duplicates(df.filter("vec_id = 152"))
    assert [(r.vec_id, r.n_links, r.kept) for r in none.collect()] == [(152, 0, True)]
    assert vector_join.near_duplicates(df.filter("false")).count() == 0


def test_packing(docs, raw, clashing):
    got = packing.pack(clashing, window=256, shard_rows=40).collect()
    want = Counter()
    tokens = {}
    for r in raw:
        ids = np.array([*packing._tokenizer().encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        tokens[r[0]] = ids
        want[(r[0], len(ids))] += 1
    seen = Counter()
    sequences = {}
    for p in got:
        ids = tokens[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        for k in range(p.start, p.start + p.length):
            seen[(p.doc_id, k)] += 1
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for (doc, n), times in want.items():
        assert all(seen[(doc, k)] == times for k in range(n))
    assert sum(seen.values()) == sum(n * t for (_, n), t in want.items())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    used = sum(seen.values())
    assert len(sequences) * 256 - used <= 256 * 6


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0


def test_both_tokenisers_agree():
    plain = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]]
    texts = ["".join(plain), " ".join(plain), "a".join(plain), "  x\n\n y\t\tz  ", "it's 12 o'clock  ", "  a"]
    for t in texts + plain:
        assert packing._ranked().encode_ordinary(t) == packing._tokenizer().encode(t, add_special_tokens=False).ids


def test_neighbours_share_rare_terms():
    tails = [np.array(t, np.uint16) for t in ([1, 2, 3, 9], [4, 5, 6, 7], [1, 2, 3, 8], [4, 5, 6, 1])]
    index = packing.Index(tails)
    index.unused[0] = False
    assert index.neighbours(tails[0])[0] == 2


def topical(n=1200, topics=40):
    """Tails of common ids and of ids of their topic."""
    draw = np.random.default_rng(6)
    common = draw.zipf(1.3, (n, 60)) % 300
    own = 1000 + draw.integers(0, topics, n)[:, None] * 50 + draw.integers(0, 50, (n, 40))
    return [np.append(c, o).astype("<u2") for c, o in zip(common, own)]


def pieces_of(spark, tails):
    rows = [(i, len(t), [], t.tobytes()) for i, t in enumerate(tails)]
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, crcs array<long>, tail binary").repartition(3)


def test_scores_are_bm25_of_the_whole_corpus(spark):
    tails = topical(300)
    corpus = packing.corpus_of(pieces_of(spark, tails))
    sets, mean = [Counter(t.tolist()) for t in tails], np.mean([len(t) for t in tails])
    df = Counter(x for s in sets for x in s)
    got = packing.Index(tails[:50], corpus).scores(7)
    for d in range(50):
        want = sum(
            np.log1p((300 - df[x] + 0.5) / (df[x] + 0.5)) * sets[d][x] * 2.2
            / (sets[d][x] + 1.2 * (0.25 + 0.75 * len(tails[d]) / mean))
            for x in sets[7] if x in sets[d]
        )
        assert abs(got[d] - want) < 1e-3 * max(want, 1)


def test_windows_are_filled_with_the_seeds_neighbours():
    """Against a plain loop: a seed's unused tails by BM25, best first, as far as they fit; the best one
    that does not fit is cut."""
    tails = [t[: 20 + 7 * (i % 11)] for i, t in enumerate(topical(120, 6))]
    index, window = packing.Index(tails), 256
    score = [index.scores(i) for i in range(len(tails))]
    left, begin, want = set(range(len(tails))), [0] * len(tails), []
    for seed in range(len(tails)):
        if seed not in left:
            continue
        left.discard(seed)
        got, room = [(seed, begin[seed], len(tails[seed]))], window - len(tails[seed]) + begin[seed]
        while room and left:
            best = sorted(left, key=lambda i: (-score[seed][i], i))[:32]
            whole = []
            for i in best:
                if len(tails[i]) - begin[i] <= room:
                    whole.append(i)
                    room -= len(tails[i]) - begin[i]
            got += [(i, begin[i], len(tails[i])) for i in whole]
            left -= set(whole)
            rest = [i for i in best if i not in whole]
            if room and rest:
                got.append((rest[0], begin[rest[0]], begin[rest[0]] + room))
                begin[rest[0]] += room
                room = 0
        want.append(got)
    assert list(packing.fill(tails, window)) == want


@pytest.mark.parametrize("shard_rows", [300, 150, 75])
def test_nearest_tails_meet_in_a_shard(spark, shard_rows):
    tails = topical()
    pieces = pieces_of(spark, tails)
    corpus = packing.corpus_of(pieces)
    shard = {r.doc_id: r.shard for r in packing.dealt(pieces, corpus, shard_rows).select("doc_id", "shard").collect()}
    assert len(shard) == 1200 and max(Counter(shard.values()).values()) <= 1.2 * shard_rows
    index, met = packing.Index(tails, corpus), []
    for seed in range(0, 1200, 6):
        near = [i for i in index.nearest(seed, 11) if i != seed][:10]
        met += [shard[i] == shard[seed] for i in near]
    assert np.mean(met) > 0.5


def test_equal_rows_are_dealt_over_shards(spark):
    tails = [np.arange(50, dtype="<u2")] * 600 + topical(300)
    pieces = pieces_of(spark, tails)
    got = packing.dealt(pieces, packing.corpus_of(pieces), 100).groupBy("shard").count().collect()
    assert sum(r["count"] for r in got) == 900 and max(r["count"] for r in got) <= 150


def brute(raw, length=100):
    first = {}
    order = sorted({(r[0] if r[0] is not None else 2**63, r[1] or "") for r in raw})
    out = {}
    for key in order:
        data = key[1].encode()
        mask = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in first:
                mask[p : p + length] = True
            else:
                first[s] = key
        spans = int((np.diff(np.append(0, mask.astype(int))) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~mask])
        out[key] = (len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd, shard, broadcast", [(20_000, 1 << 15, 10**6), (1, 500, 0)])
def test_repeated_passages(clashing, raw, monkeypatch, crowd, shard, broadcast):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", broadcast)
    want = brute(raw)
    texts = Counter((r[0], (r[1] or "")) for r in raw)
    got = Counter(tuple(r) for r in suffix_dedup.deduplicate(clashing).collect())
    expected = Counter()
    for (doc, text), times in texts.items():
        expected[(doc, *want[(doc if doc is not None else 2**63, text)])] += times
    assert got == expected


def shared_passage(n=240):
    """Different documents around one passage, some rows twice."""
    draw = random.Random(3)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(160))
    texts = ["".join(draw.choice("ijklmnop ") for _ in range(120)) + passage + f" {i} " * 30 for i in range(n)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, *rows[:5], (None, "q" * 90 + passage)]


def test_strings_of_a_crowded_anchor_leave_a_task_once(spark):
    rows = [(i, 0, t.encode()) for i, t in shared_passage()]
    texts = spark.createDataFrame([r for r in rows if r[0] is not None], "ord long, tag long, data binary").coalesce(2)
    places = suffix_dedup.anchored(texts, 100, 32).selectExpr("anchor", "3L as splits", "ord", "place", "0L as tag")
    strings = suffix_dedup.cut_out(texts, places.distinct(), 100).collect()
    met = Counter((r.anchor, bytes(r.data)) for r in strings if r.data is not None)
    tasks = texts.rdd.getNumPartitions()
    assert max(met.values()) <= tasks and sum(r.data is None for r in strings) >= 61 * (240 - tasks)
    hot = Counter((r.anchor, r.part) for r in strings if r.data is None)
    assert max(hot.values()) <= 10


def test_firsts_give_every_place_once():
    firsts, draw = suffix_dedup.Firsts(), random.Random(4)
    rows = [(1, draw.randrange(9), draw.randrange(9) << 30, draw.choice([b"x", b"y"])) for _ in range(300)]
    again = [firsts.add(a, 1, o, p, d) for a, o, p, d in rows]
    first = {d: min((o, p) for _, o, p, e in rows if e == d) for d in (b"x", b"y")}
    assert {(r[4], r[2:4]) for r in firsts.taken()} == set(first.items()) and not firsts.rows
    want = {(o, p) for _, o, p, d in rows if (o, p) != first[d]}
    assert {r[2:4] for r in again if r} == want and all(r[1] < 0 for r in again if r)


def test_a_passage_in_very_many_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 50)
    monkeypatch.setattr(suffix_dedup, "TASK", 2000)
    raw = shared_passage()
    docs = spark.createDataFrame(raw, "doc_id long, text string").repartition(4)
    want = brute(raw)
    got = Counter(tuple(r) for r in suffix_dedup.deduplicate(docs).collect())
    assert got == Counter((doc, *want[(doc if doc is not None else 2**63, text)]) for doc, text in raw)


def test_repeated_passages_of_nothing(empty):
    assert suffix_dedup.deduplicate(empty).count() == 0


@pytest.mark.parametrize("length", [7, 8])
def test_merged_blocks_are_common_prefixes(length):
    draw = np.random.default_rng(5)
    strings = [bytes(draw.choice(list(b"ab"), size=draw.integers(1, 40)).astype(np.uint8)) for _ in range(60)]
    shard, suffix_dedup.SHARD = suffix_dedup.SHARD, 100
    try:
        own, far = suffix_dedup.repeats(strings, np.arange(60), np.zeros(60, np.int64), length)
    finally:
        suffix_dedup.SHARD = shard
    seen, want = set(), set()
    for i, s in enumerate(strings):
        for p in range(len(s) - length + 1):
            want |= {(i, p)} if s[p : p + length] in seen else set()
            seen.add(s[p : p + length])
    assert set(zip(own.tolist(), far.tolist())) == want
