"""Quality rules: base rules on counts, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into buckets.  Two multinomials over them are counted, one over
a trusted target (documents labelled good) and one over the whole corpus; a document's score is
the mean over its n-grams of the log ratio of the two.  It is kept if the score reaches a
threshold: the score that all but a stated share of the trusted documents reach, lowered half
way to the one that as good as all documents labelled bad stay under, if there is a gap.

Everything runs in built-in expressions.  Null and empty texts have no words, fail the base
rules and score 0.  Texts of any length are read whole.  Equal rows give equal results; an empty table gives
none; other columns are ignored.  A label without an id or a quality does not count; without labels what
passes the base rules is kept.  The trusted target is a bounded sample of labelled rows (``LABELLED_ROWS``);
the corpus is counted whole, and the threshold is taken from every labelled row that is not in the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import bind, words
from wattframe.session import stored

BUCKETS = 10_000
#: Labelled rows the target is fitted on, the first by a hash of doc_id.
LABELLED_ROWS = 20_000
SMOOTHING = 1.0
#: Share of the trusted documents that may fall below the threshold, and of the bad above it.
BELOW, ABOVE = 0.0005, 0.01
SYMBOL = r"[#*$%&|<>]"


def _shifted(w: Column, by: int, width: int) -> Column:
    return F.slice(w, F.lit(by + 1), F.greatest(F.size(w) - width + 1, F.lit(0)))


def repeated(w: Column) -> Column:
    """Words inside three-word windows that occur more than once.

    Windows are compared by a 64-bit hash.  Only if some are equal, they are sorted with their
    places; the covered words are then counted along the places, none of them twice.
    """
    hashed = bind(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda v: F.zip_with(
            F.zip_with(_shifted(v, 0, 3), _shifted(v, 1, 3), lambda a, b: F.xxhash64(a, b)),
            _shifted(v, 2, 3),
            lambda p, c: F.xxhash64(p, c),
        ),
    )

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                before = F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                return before | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def count(at: Column) -> Column:
            steps = F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(3)), F.lit(3)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return bind(bind(placed, places), count)

    return bind(
        hashed,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
    ).cast("long")


def base_of(t: Column, w: Column) -> Column:
    """Struct of the counts that the base rules read, from a text and its words."""
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeats = bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    letters = F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        letters.alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        repeats.cast("long").alias("n_dup_lines"),
        repeated(w).alias("n_repeat_words"),
    )


def base(text: Column) -> Column:
    return bind(F.coalesce(text, F.lit("")), lambda t: bind(words(t), lambda w: base_of(t, w)))


def features_of(w: Column, buckets: int) -> Column:
    """Buckets of all words and word pairs."""
    single = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    pairs = F.zip_with(
        _shifted(w, 0, 2),
        _shifted(w, 1, 2),
        lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"),
    )
    return F.concat(single, pairs)


def features(text: Column, buckets: int = BUCKETS) -> Column:
    return bind(words(text), lambda w: features_of(w, buckets))


def labelled(labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(good_id, good, target): every labelled document; those with both labels have two rows.

    ``target`` marks the trusted documents, at most ``rows``: half of the good ones, none of them
    toxic, the first by a hash.  The threshold is taken from all others, whose own n-grams are not in
    the target.
    """
    listed = labels.filter("doc_id is not null and quality is not null").select(
        F.col("doc_id").alias("good_id"), (F.col("quality") == 1).alias("good"), "toxic"
    )
    clean = F.coalesce(F.max("toxic"), F.lit(0)) == 0
    ids = stored(listed.groupBy("good_id", "good").agg(clean.alias("clean")), "labels")
    half = F.crc32(F.col("good_id").cast("string")) % 2 == 0
    trusted = ids.filter(F.col("good") & F.col("clean") & half).select("good_id", "good")
    trusted = trusted.orderBy(F.md5(F.col("good_id").cast("string")), "good_id").limit(rows)
    marked = F.broadcast(trusted.withColumn("target", F.lit(True)))
    return ids.join(marked, ["good_id", "good"], "left").select(
        "good_id", "good", F.coalesce("target", F.lit(False)).alias("target")
    )


def log_ratios(
    docs: DataFrame, good: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING
) -> DataFrame:
    """One row, ``ratios``: the log ratio of target and corpus probability of each bucket."""
    marked = docs.select("doc_id", "text").join(
        F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left"
    )
    seen = (
        marked.select(F.col("good_id").isNotNull().alias("good"), F.explode(features(F.col("text"), buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count_if("good").alias("n_good"), F.count("*").alias("n_all"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(seen, "bucket", "left").na.fill(0)
    listed = F.array_sort(F.collect_list(F.struct("bucket", "n_good", "n_all")))
    return full.agg(
        listed.alias("counts"), F.sum("n_good").alias("good"), F.sum("n_all").alias("all")
    ).select(
        F.transform(
            "counts",
            lambda c: F.log((c["n_good"] + smoothing) / (F.col("good") + smoothing * buckets))
            - F.log((c["n_all"] + smoothing) / (F.col("all") + smoothing * buckets)),
        ).alias("ratios")
    )


def score_of(w: Column, ratios: Column, buckets: int = BUCKETS) -> Column:
    """Mean log ratio over the n-grams of words; 0 if there are none."""

    def mean(found: Column) -> Column:
        total = bind(
            ratios,
            lambda r: F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(r, b)),
        )
        return F.when(F.size(found) > 0, total / F.size(found)).otherwise(0.0)

    return bind(features_of(w, buckets), mean)


def order_statistics(values: DataFrame, ranks: list[int], bins: int = 4096) -> dict[int, float]:
    """The values (of column ``x``) at the given ranks, from 0, of all rows.

    Rows are counted per bin of their range; the bin with the rank is cut again, until it holds few rows or
    one value.  Counts per bin and the last few values are all that meets on the driver.
    """
    out: dict[int, float] = {}
    todo = [(values, 0, sorted(set(ranks)))]
    while todo:
        part, before, wanted = todo.pop()
        low, high, n = part.agg(F.min("x"), F.max("x"), F.count("*")).first()
        if low == high:
            out |= dict.fromkeys(wanted, low)
            continue
        if n <= bins:
            listed = sorted(r["x"] for r in part.collect())
            out |= {k: listed[k - before] for k in wanted}
            continue
        # two values apart fall into two bins at least, or the range shrinks no more
        place = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1))
        cut = part.withColumn("bin", place)
        counts = sorted((r["bin"], r["count"]) for r in cut.groupBy("bin").count().collect())
        for b, count in counts:
            own = [k for k in wanted if before <= k < before + count]
            if own:
                todo.append((cut.filter(F.col("bin") == b).drop("bin"), before, own))
            before += count
    return out


def quantile(values: DataFrame, share: float) -> float | None:
    """The quantile of column ``x`` between neighbours in proportion; None without rows."""
    n = values.count()
    if not n:
        return None
    place = share * (n - 1)
    low, high = int(place), min(int(place) + 1, n - 1)
    found = order_statistics(values, [low, high])
    return found[low] + (found[high] - found[low]) * (place - low)


def threshold(scored: DataFrame, sample: DataFrame) -> float:
    """The score needed, from every labelled document outside the target that passes the base rules."""
    unseen = sample.filter(~F.col("target"))
    passing = scored.filter(~F.col("base_failed"))
    own = passing.join(unseen, F.col("doc_id") == F.col("good_id")).select("good", F.col("score").alias("x"))
    own = stored(own, "labelled-scores")
    low = quantile(own.filter("good").select("x"), BELOW)
    high = quantile(own.filter(~F.col("good")).select("x"), 1 - ABOVE)
    if low is None:
        return float("-inf")
    return low - max(low - high, 0.0) / 2 if high is not None else low


def judge(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """One row per document: counts, base verdict, score and final verdict.

    Two passes over the texts: one counts n-grams, one scores.  Scores are written before the
    threshold is taken from them.
    """
    sample = stored(labelled(labels, rows), "labelled")
    ratios = stored(log_ratios(docs, sample.filter("target")), "ratios")

    def both(t: Column) -> Column:
        return bind(
            words(t), lambda w: F.struct(base_of(t, w).alias("b"), score_of(w, F.col("_ratios")).alias("score"))
        )

    judged = (
        docs.select("doc_id", "text", ratios.scalar().alias("_ratios"))
        .select("doc_id", bind(F.coalesce("text", F.lit("")), both).alias("x"))
        .select("doc_id", "x.b.*", "x.score")
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = stored(judged.withColumn("base_failed", failed), "scores")
    cut = threshold(scored, sample)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(cut)))
