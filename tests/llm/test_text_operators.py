"""Operators on single documents, held against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from wattframe.llm import extract, langid, mixing, pii, quality, sharding
from wattframe.llm.common import words


def jump(key: int, shards: int) -> int:
    """The published loop."""
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 300])
def test_jump_is_the_published_function(spark, shards):
    keys = [0, 1, 7, 256, -1, -(2**63), 2**63 - 1, *range(1000, 1200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.s for r in df.select("k", sharding.shard(df["k"], shards).alias("s")).collect()}
    assert got == {k: jump(k, shards) for k in keys}


def test_sharding(docs, raw):
    got = sharding.assign(docs, 16, block_rows=10).collect()
    assert len(got) == len(raw)
    for r in got:
        assert r.shard == jump(r.doc_id or 0, 16) and r.grown_shard == jump(r.doc_id or 0, 17)
        assert r.grown_shard in (r.shard, 16)
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes = sorted((r.size, r.text_crc32) for r in got)
    data = [(x[1] or "").encode() for x in raw]
    assert sizes == sorted((len(d) + 1, zlib.crc32(d)) for d in data)


def shape(text: str | None):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {g for g in grams if grams.count(g) > 1}
    covered = {i + k for i, g in enumerate(grams) if g in again for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_base_rules(spark):
    texts = [None, "", " ", "a", "a b c a b c a", "x y z\nx y z\n\n \nq", "#a *b $ %% <é>\x0bü\x0c a", "a a a a a a", "p q r s p q r t " * 40]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [tuple(r.b) for r in df.select(quality.base(df["text"]).alias("b")).collect()]
    assert got == [shape(t) for t in texts]


def test_words_split_on_listed_spaces_only(spark):
    df = spark.createDataFrame([("a b c\x1cd\x0be",)], "text string")
    assert df.select(words(df["text"])).first()[0] == ["a b", "c\x1cd", "e"]


def test_quality_prefers_the_target(spark):
    good = [(i, f"the cat sat on mat number {i} and " * 12 + "end") for i in range(40)]
    good = [(i, " ".join(f"w{(i * 7 + k * k) % 90}" for k in range(80))) for i, _ in good]
    bad = [(100 + i, " ".join(f"z{(i * 5 + k * k) % 90}!!" for k in range(80))) for i in range(40)]
    docs = spark.createDataFrame([*good, *bad, (500, None)], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, 1, 0) for i, _ in good[:30]] + [(i, 0, 0) for i, _ in bad[:30]] + [(None, 1, 0), (7, None, None)],
        "doc_id long, quality int, toxic int",
    )
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(got) == 81 and got[500].base_failed and not got[500].kept and got[500].score == 0
    assert all(got[i].kept for i, _ in good) and not any(got[i].kept for i, _ in bad)


def test_quality_without_labels_keeps_what_passes_the_base(docs, spark, raw):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(raw) and all(r.kept != r.base_failed for r in got)


def test_mixture(docs, raw):
    got = mixing.mix(docs, block_rows=7).collect()
    assert len(got) == len(raw)
    total = sum(r["size"] for r in got)
    per = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and len(r.times) == r.passes
        assert all(0 <= t <= 1 for t in r.times) and r.times == sorted(r.times)
        per.setdefault(r.source, []).append(r)
    assert abs(sum(x[0].target for x in per.values()) - 1.5 * total) < 1e-6 * total
    for rows in per.values():
        assert rows[0].target <= 2 * rows[0].source_size
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r["size"] for r in rows)
    again = mixing.mix(docs.repartition(5), block_rows=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_targets_by_repeated_resharing(spark):
    sizes = {"a": 10, "b": 400, "c": 1000, "d": 30, "e": 0, None: 77}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    weight = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1]))
    left, open_, want = 1.5 * sum(sizes.values()), dict(weight), {}
    while True:
        level = left / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
            del open_[s]
    want |= {s: level * w for s, w in open_.items()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("schedule", [*mixing.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (0.3001, 0.1), (1.0, 0.1))])
def test_schedule_inverse(spark, schedule):
    """Against sums over a fine grid: the share due by the time found is the share asked for."""
    shares = [i / 40 for i in range(41)]
    df = spark.createDataFrame([(s,) for s in shares], "share double")
    found = [r.t for r in df.select(mixing.time_due(df["share"], schedule).alias("t")).collect()]

    def weight(t):
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            if t <= t1:
                return w0 + (w1 - w0) * (t - t0) / (t1 - t0)

    n = 20_000
    steps = [weight((i + 0.5) / n) for i in range(n)]
    for share, t in zip(shares, found):
        due = sum(steps[: round(t * n)]) / sum(steps)
        assert abs(due - share) < 2e-3 and 0 <= t <= 1 + 1e-9
    assert found == sorted(found)


def test_positions_follow_the_schedules(docs, raw):
    early, late = ((0.0, 9.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 9.0))
    mean = {}
    for name, schedules in (("early", [early] * 3), ("late", [late] * 3)):
        got = mixing.in_order(docs, schedules=schedules, block_rows=9).collect()
        assert len(got) == len(raw)
        taken = [r for r in got if r.passes]
        assert all(r.first_time == r.times[0] and r.last_time == r.times[-1] for r in taken)
        assert all(r.first_time is None for r in got if not r.passes)
        firsts = [r.first_time for r in got]
        assert firsts == sorted(firsts, key=lambda t: (t is None, t))
        # each pass stands where its source's demand reaches the middle of the document
        for r in taken:
            share = [0.0]
            for t in r.times:
                low, high = schedules[0][0][1], schedules[0][1][1]
                share.append((low * t + (high - low) * t * t / 2) / ((low + high) / 2))
            steps = [b - a for a, b in zip(share[1:], share[2:])]
            assert all(abs(x * r.target - r.source_size) < 1e-6 * r.source_size for x in steps[:-1] or steps if r.passes > 2)
        mean[name] = sum(r.first_time for r in taken) / len(taken)
    assert mean["early"] < mean["late"]


def test_curriculum_repeats_and_sorts(spark, docs, empty, raw):
    names = "place _mix_id _mix_rows _mix_words times block nth size _row _time _doc".split()
    rows = [*raw, *[(None, "equal in id and size", "a", "a", 1)] * 30, *[(None, "other in id only now", "a", "a", 1)] * 30]
    table = spark.createDataFrame(rows, docs.schema).select("*", *[F.lit("x").alias(c) for c in names])
    drawn = mixing.mix(table.select(*docs.columns)).collect()
    out = mixing.curriculum(table, block_rows=7)
    assert out.columns == table.columns
    got = out.collect()
    assert len(got) == sum(r.passes for r in drawn)
    per_id = lambda x: sorted(((r.doc_id is None, r.doc_id or 0) for r in x for _ in range(getattr(r, "passes", 1))))
    assert per_id(got) == per_id(drawn)
    assert {r.text for r in got if r.doc_id is None} >= {"equal in id and size", "other in id only now"}
    # documents with an id of their own come in the order of their training times
    times = {}
    for r in drawn:
        times.setdefault(r.doc_id, []).extend(r.times)
    once = {d: t[0] for d, t in times.items() if len(t) == 1}
    order = [once[r.doc_id] for r in got if r.doc_id in once]
    assert order == sorted(order) and len(order) > 20
    assert mixing.curriculum(empty).count() == 0


def base_spans(text: str | None):
    text, out = text or "", []
    def luhn(d):
        return sum((n * 2 - 9 if n > 4 else n * 2) if i % 2 else n for i, n in enumerate(map(int, reversed(d)))) % 10 == 0
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(f"email:{m.start()}:{m.end()}")
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(f"ip:{m.start()}:{m.end()}")
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(f"card:{m.start()}:{m.end()}")
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(f"phone:{m.start()}:{m.end()}")
    return ",".join(out)


PII = [
    None, "", "a@b.c_d@e.f @x.y a@@b.c ü.x@é.com foo.bar+1@mail-2.example.org.", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 0001.2.3.255",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111", "+1 (212) 555-0100, +1 2 +12345678901234567 +49 30 1234567-",
    "1" * 3000 + ".1.1.1 " + "a" * 3000 + "@" + "b" * 10, "x@y.z@w.q 12.34.56.78@a.b",
]


@pytest.mark.parametrize("text", PII)
def test_base_spans_are_the_patterns(text):
    assert pii.describe(pii.find(text), pii.BASE) == base_spans(text)


def test_checksums_and_context():
    kinds = lambda t: [s[0] for s in pii.find(t)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 please") == ["iban"]
    assert kinds("GB82WEST12345698765432") == ["iban"] and kinds("GB82WEST12345698765431") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("visa card 378282246310005") == ["short_card"] and kinds("serial 378282246310005") == []
    assert pii.mask("write a.b@c.de now", pii.find("write a.b@c.de now")) == "write [email] now"


def test_every_span_has_a_score_moved_by_the_words_around():
    def worth(text):
        return {k: round(x, 2) for k, _, _, x in pii.find(text)}

    assert worth("4111111111111111") == {"card": 0.8} and worth("Kreditkarte 4111111111111111") == {"card": 1.0}
    assert worth("serial 4111111111111111") == {"card": 0.5}  # a base span stays
    assert worth("version 10.0.0.1") == {"ip": 0.4} and worth("Server 10.0.0.1") == {"ip": 1.0}
    assert worth("llame al +34 600 123 456 hoy") == {"phone": 1.0} and worth("x +34 600 123 456") == {"phone": 0.7}
    for word in ("Sozialversicherung", "taxpayer", "seguridad", "sociale"):
        assert worth(f"{word}: 123-45-6789") == {"ssn": 0.7}
    # a word counts within eight words, on either side, however long those are
    far = " ".join(f"{'w' * 90}{i}" for i in range(7))
    assert worth(f"123-45-6789 {far} ssn") == {"ssn": 0.7} and worth(f"ssn {far} w 123-45-6789") == {}
    assert worth(f"{'taxpayers ' * 5}123-45-6789") == {}


def test_many_spans_do_not_slow_each_other():
    import time

    text = "card 378282246310005 x DE89 3704 0044 0532 0130 00, " * 20_000
    begin = time.time()
    found = pii.find(text)
    assert len(found) == 40_000 and time.time() - begin < 30


def test_detect_and_redact(spark, docs, raw, empty, clashing):
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(PII)], "doc_id long, text string, n_chars long")
    for r in pii.detect(df).collect():
        assert r.base_sha256 == hashlib.sha256(base_spans(PII[r.doc_id]).encode()).hexdigest()
        assert r.n_email == base_spans(PII[r.doc_id]).count("email:")
    out = pii.redact(df).collect()
    assert out[0].text is None and all(len(r.text) == r.n_chars for r in out if r.text is not None)
    assert pii.detect(docs).count() == len(raw) and pii.detect(empty).count() == 0
    assert pii.redact(clashing).columns == clashing.columns and pii.redact(clashing).count() == len(raw)


def test_main_text():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body class='has-sidebar'><nav><a href=/>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies</div><header>Site</header><div id=main><h1>A  title</h1>"
        "<p>First &amp; best, with\n commas, <a href=x>a link</a> and more words here.<p>Second<script>var x='</p>'</script> one."
        "</div><aside>Side</aside><div class='comments'><p>Reader, says, hello, there, friends</p></div><footer>&copy; f</footer>"
    )
    assert extract.main_text(page) == "A title\n\nFirst & best, with commas, a link and more words here.\n\nSecond one."
    assert extract.main_text(None) == "" and extract.main_text("") == ""
    assert extract.main_text("<article><p>Cut off <b>here") == "Cut off here"
    assert extract.main_text("<article><p>One</p><!-- no end <p>x") == "One"
    assert extract.main_text("<div><p>5 < 6 and a<b>c</b></p></div>") == "5 < 6 and ac"
    assert extract.main_text("<p>" * 3000 + "deep") == "deep"
    assert extract.main_text("<div>" * 3000 + "<p>deep") == "deep"


def test_pages(spark, sf_dir):
    pages = spark.createDataFrame([(1, "u", None), (None, None, "<p>a</p>")], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in extract.extract(pages).collect()) == [("", 0), ("a", 1)]
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").join(
        extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url"), "page_id"
    ).limit(50).collect():
        body = r.html[r.html.index("<article>") :].split("<footer>")[0].split("</article>")[0]
        plain = " ".join(re.sub(r"<[^>]*>?", " ", body).split())
        assert " ".join(r.text.split()) == extract.html.unescape(plain)


def test_language(spark, sf_dir, docs, empty, raw):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.identify(table, langid.Settings(per_language=40)).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    odd = langid.identify(docs, langid.Settings(per_language=20, passes=1)).collect()
    assert len(odd) == len(raw)
    assert {r.lang_pred for r in odd if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert langid.identify(empty).count() == 0
    unlabelled = langid.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_long_texts_are_scored_as_short_ones():
    import numpy as np

    settings, table = langid.Settings(), np.random.default_rng(0).random((3, 1 << 16))
    text = "abc déf ghi " * 40_000
    whole, _ = langid.scores([text, "other"], np.zeros(3), table, settings)
    begin = langid.STEP
    langid.STEP = 1000
    try:
        parts, _ = langid.scores([text, "other"], np.zeros(3), table, settings)
    finally:
        langid.STEP = begin
    assert np.allclose(whole, parts)


SENTENCE = "Some words of the article, which go on, and on, until there is enough of it to be read. "


@pytest.mark.parametrize(
    "opening, closing",
    [
        ("<div class='layout has-sidebar'><article><p>", "</article></div>"),
        ("<div class='layout has-sidebar'><p>", "</div>"),
        ("<div class='elementor-widget elementor-widget-text-editor'><p>", "</div>"),
        ("<div class=widget><main><p>", "</main></div>"),
        ("<form id=aspnetForm><p>", "</form>"),
        ("<body>", "</body>"),
        ("<main>", "</main>"),
        ("<center>", "</center>"),
        ("<figure>", "</figure>"),
    ],
)
def test_no_wrapper_and_no_block_loses_the_article(opening, closing):
    menu = "<nav><a href=/>Home</a></nav><div class=sidebar>Read more</div>"
    assert extract.main_text(f"{menu}{opening}{SENTENCE * 5}{closing}") == (SENTENCE * 5).strip()


def test_an_article_in_many_widgets_is_kept_and_small_boxes_go():
    parts = "".join(f"<div class='elementor-widget w{i}'><p>{i} {SENTENCE}</p></div>" for i in range(9))
    page = f"<body>{parts}<div class='share-box'>Tell your friends</div><aside>Side</aside></body>"
    assert extract.main_text(page).split("\n\n") == [f"{i} {SENTENCE}".strip() for i in range(9)]


def test_comments_and_teasers_do_not_replace_the_article():
    said = f"<article class='comment-body'><p>{SENTENCE * 3}</p></article>"
    teasers = "<div class='related'><article><p>Another one, to read next.</p></article></div>"
    page = f"<article><p>{SENTENCE * 4}</p><div id=comments>{said * 5}</div></article>{teasers}"
    assert extract.main_text(page) == (SENTENCE * 4).strip()
