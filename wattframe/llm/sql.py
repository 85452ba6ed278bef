"""The same results in DuckDB's SQL, for the queries that SQL can express.

Quality rules (their hash), language id, packing, page extraction and personal data have none; their
tests hold them against plain Python instead.
"""

from __future__ import annotations

from wattframe.llm.mixing import SCHEDULES, demand

_SIZE = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"

NEAR_TEXTS = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) < 5 THEN [w] ELSE
    list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4]) END) AS g
  FROM words WHERE len(w) > 0
), sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
shared AS (
  SELECT a.r AS x, b.r AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r
), links AS (
  SELECT x, y FROM shared JOIN sizes s ON s.r = x JOIN sizes t ON t.r = y WHERE 10 * k >= 8 * (s.n + t.n - k)
), reach AS (
  SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), least AS (SELECT x, min(doc_id) AS m FROM reach JOIN words ON words.r = y GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_links, least(doc_id, coalesce(m, doc_id)) AS class_id,
       least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
FROM words LEFT JOIN least ON least.x = r LEFT JOIN counts ON counts.x = r
"""

NEAR_VECTORS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), least AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN least ON least.x = vec_id LEFT JOIN counts ON counts.x = vec_id
"""



def _double(x: float) -> str:
    return f"{x:.17e}"


def _time_due(share: str) -> str:
    """The inverse of the integrated schedules, line by line, for the source's kind."""
    kinds = []
    for schedule in SCHEDULES:
        lines, total = demand(schedule)
        here = []
        for t0, w0, slope, before, _ in lines:
            area = f"(({share} - {_double(before)}) * {_double(total)})"
            if slope:
                root = f"sqrt(greatest({_double(w0 * w0)} + {_double(2 * slope)} * {area}, 0.0::DOUBLE))"
                here.append(f"{_double(t0)} + ({root} - {_double(w0)}) / {_double(slope)}")
            else:
                here.append(f"{_double(t0)} + {area} / {_double(w0)}")
        upto = " ".join(f"WHEN {share} <= {_double(line[4])} THEN {h}" for line, h in zip(lines[:-1], here))
        kinds.append(f"CASE {upto} ELSE {here[-1]} END" if upto else here[-1])
    by_kind = "CASE kind " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(kinds)) + " END"
    return f"CASE WHEN {share} IS NOT NULL THEN {by_kind} END"


MIXING = f"""
WITH sized AS (
  SELECT doc_id, {_SIZE} AS size, source, md5(coalesce(doc_id::VARCHAR, '')) AS place FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind, ([5.0, 2.0, 1.0])[1 + kind]::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (1.5 * sum(source_size::DOUBLE) OVER ()
             - 2.0 * coalesce(sum(source_size::DOUBLE) OVER (ORDER BY source_size / weight, source NULLS LAST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), plan AS (
  SELECT source, source_size, kind, least(2.0 * source_size::DOUBLE, max(level) OVER () * weight) AS target FROM levels
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized
), drawn AS (
  SELECT doc_id, size, source_size, target, before, kind,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
  FROM placed JOIN plan ON placed.source IS NOT DISTINCT FROM plan.source
), passed AS (
  SELECT *, (CASE WHEN size > 0 THEN whole + CASE WHEN 2 * before + size < 2 * (target - whole * source_size)
             THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS passes
  FROM drawn
), shares AS (
  SELECT *, CASE WHEN passes > 0 THEN least((before::DOUBLE + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) END AS first_share,
         CASE WHEN passes > 0 THEN
           least((((passes - 1) * source_size + before)::DOUBLE + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) END AS last_share
  FROM passed
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * passes)::BIGINT AS taken,
       {_time_due("first_share")} AS first_time, {_time_due("last_share")} AS last_time
FROM shares
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), lengths AS (SELECT unnest(range(1, 6)) AS m),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM pieces JOIN lengths ON len(w) >= m
), totals AS (SELECT lang, count(*) AS n FROM grams WHERE m = 1 GROUP BY lang),
counts AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
split AS (SELECT *, string_split(phrase, ' ') AS w FROM counts),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM split JOIN (SELECT unnest(range(1, 5)) AS k) ON k < m
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n,
         ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = head
  JOIN counts y ON y.lang = c.lang AND y.phrase = rest JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored
), parts AS (
  SELECT lang, m, a, w, unnest(range(2, m)) AS size FROM split
), inside AS (
  SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - size + 2)) AS i FROM parts) GROUP BY ALL
), ranked AS (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank,
         w.phrase, a, l, r, n, score
  FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 100 * a)
)
SELECT * FROM ranked WHERE rank <= 2000
"""

TOP_K = """
WITH numbered AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
), pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM numbered q JOIN numbered c ON q.r <> c.r AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM pairs
) WHERE rank <= 5
"""

#: The checksum runs over half bytes, the low one first, with a table of 16 entries made in place.
SHARDS = r"""
WITH RECURSIVE listed AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h,
         (doc_id::HUGEINT + CASE WHEN doc_id < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END) AS key
  FROM documents
), table16 AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(16))::BIGINT AS i))
), sums AS (
  SELECT r, doc_id, key, strlen(h) // 2 + 1 AS size,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(
             CASE WHEN h = '' THEN [] ELSE string_split(regexp_replace(h, '(.)(.)', '\2\1', 'g'), '') END,
             lambda c: instr('0123456789ABCDEF', c)::BIGINT - 1)),
           lambda a, x: xor(t[1 + (xor(a, x) & 15)], a >> 4))) AS text_crc32
  FROM listed, table16
), walk AS (
  SELECT r, coalesce(key, 0) AS key, -1::BIGINT AS past, -1::BIGINT AS here, 0::BIGINT AS next, 17 AS shards FROM sums
  UNION ALL
  SELECT r, k, here, next,
         floor((next + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k // 8589934592)::DOUBLE + 1)))::BIGINT, shards
  FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS k FROM walk WHERE next < shards)
), ends AS (
  SELECT r, here, past FROM walk WHERE next >= shards
), placed AS (
  SELECT s.*, CASE WHEN here = 16 THEN past ELSE here END::INTEGER AS shard, here::INTEGER AS grown_shard
  FROM sums s JOIN ends USING (r)
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM placed
"""

#: Every 100-byte string by its digest; what it covers is cut out of the text's hexadecimal form.
REPEATS = """
WITH listed AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, coalesce(text, '')) AS r, doc_id,
         hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n
  FROM documents
), starts AS (
  SELECT r, p, md5(substr(h, 2 * p + 1, 200)) AS s
  FROM (SELECT r, h, unnest(range(0, n - 99)) AS p FROM listed WHERE n >= 100)
), again AS (
  SELECT r, p FROM (SELECT r, p, row_number() OVER (PARTITION BY s ORDER BY r, p) AS nth FROM starts) WHERE nth > 1
), marked AS (
  SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM again
), numbered AS (
  SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS run FROM marked
), spans AS (
  SELECT r, run, min(p) AS first, max(p) + 100 AS past FROM numbered GROUP BY r, run
), gaps AS (
  SELECT r, first, past, coalesce(lag(past) OVER (PARTITION BY r ORDER BY first), 0) AS before FROM spans
), cut AS (
  SELECT r, count(*) AS n_spans, sum(past - first) AS n_removed, max(past) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (first - before)), '' ORDER BY first) AS left_hex
  FROM gaps JOIN listed USING (r) GROUP BY r
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN h ELSE left_hex || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM listed LEFT JOIN cut USING (r)
"""

#: Places with equal words and their distance; places in a row at one distance are a stretch of that period.
RUNS = r"""
WITH listed AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         hex(encode(doc_id::VARCHAR)) AS h
  FROM documents
), table16 AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(16))::BIGINT AS i))
), checked AS (
  SELECT r, doc_id, w, len(w) AS n,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(
             string_split(regexp_replace(h, '(.)(.)', '\2\1', 'g'), ''), lambda c: instr('0123456789ABCDEF', c)::BIGINT - 1)),
           lambda a, x: xor(t[1 + (xor(a, x) & 15)], a >> 4))) AS h
  FROM listed, table16
), planted AS (
  SELECT *, (h // 10) % greatest(n, 1) AS a FROM checked
), texts AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w
  FROM planted
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM texts
), equal AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND x.i < y.i
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal) e GROUP BY r, q, island
), runs AS (
  SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS left_words FROM words
  WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.r = words.r AND i >= start + period AND i < start + length) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines,
         first({'s': start, 'l': length, 'p': period} ORDER BY length DESC, start, period) AS best
  FROM runs GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length,
       best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(left_words, '')) AS collapsed_sha256
FROM texts LEFT JOIN found USING (r) LEFT JOIN kept USING (r)
"""

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": NEAR_TEXTS,
    "op2_sharding": SHARDS,
    "op3_embedding_near_dedup": NEAR_VECTORS,
    "op5_source_mixing": MIXING,
    "op10_suffix_array_dedup": REPEATS,
    "op11_collocations": COLLOCATIONS,
    "op12_periodic_runs": RUNS,
    "op13_topk_search": TOP_K,
}
