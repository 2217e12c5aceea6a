"""The queries of this package, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, langid, mixing, quality, ranked, resampling, simhash, spans, suffixes, toxicity, urls, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), boosts=mixing.BOOSTS)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", "text")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    failed = quality.base_failed()
    counted = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(*counted, failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "quality")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return resampling.resample(docs.select("doc_id", "text"), target).select("doc_id", "n_features", "weight", "score", "rank")


def op12_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op7 SQL can say: host, path, rule, and the rule's verdict."""
    rule, verdict = urls.rule_columns()
    return urls.with_host_and_path(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op9 SQL can say: the base counts of whole texts."""
    counted = quality.counts(_table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_warc, op2_language_id, op3_mix_sources, op4_byte_bpe, op5_sorted_projections,
        op6_sentence_spans, op7_url_filter, op8_toxicity, op9_quality_rules, op10_simhash, op11_resample, op12_suffix_array, op13_ranked_search, url_rules, quality_counts,
    )}


#: The same inversion in DuckDB: rates by source, the cumulative distribution, one row a copy.
OP3_SQL = f"""
WITH boosts(name, times) AS (VALUES {", ".join(f"('{name}', {times})" for name, times in mixing.BOOSTS.items())}),
counts AS (
  SELECT source, n, pow(n, {mixing.TEMPER}) * coalesce(times, 1.0) AS weight
  FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) LEFT JOIN boosts ON name = source
),
rates AS (SELECT source, (SELECT sum(n) FROM counts) * weight / (SELECT sum(weight) FROM counts) / n AS rate FROM counts),
steps AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM rates, unnest(generate_series(0, CAST(ceil(rate + 10 * sqrt(rate) + 20) AS BIGINT))) AS s(k)
),
upto AS (SELECT source, list(p ORDER BY k) AS upto FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS p FROM steps) GROUP BY source),
keyed AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key FROM documents),
drawn AS (SELECT *, CAST('0x' || md5('{mixing.SEED}:' || key)[1:13] AS BIGINT) / 4503599627370496.0 AS u FROM keyed)
SELECT doc_id, text, lang, d.source, n_chars, CAST(c.copy AS INTEGER) AS copy, md5('{mixing.SEED}:' || key || ':' || c.copy) AS order_key
FROM drawn d JOIN upto ON d.source IS NOT DISTINCT FROM upto.source,
     unnest(generate_series(0, len(list_filter(upto, lambda p: p <= u)) - 1)) AS c(copy)
"""


OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {warc.REVISIT_FROM} AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.REVISIT_FROM} AND page_id < newest THEN newest END AS refers_to
FROM g
"""


def _rule_sql(of: int) -> str:
    """The longest rule that fits, or its verdict, as a CASE."""
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
    return "CASE " + " ".join(f"WHEN {fits(*r[0].split('/', 1))} THEN '{r[of]}'" for r in sorted(urls.RULES, key=lambda r: -len(r[0]))) + " END"


URL_RULES_SQL = rf"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
)
SELECT page_id, host, path, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS verdict FROM parts
"""


QUALITY_COUNTS_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER v || ' ' || lead(x, 2) OVER v AS g FROM u WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM k WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
c AS (
  SELECT l.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM l LEFT JOIN covered ON covered.doc_id = l.doc_id
)
SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""


#: Words of a text as in op11 and op13; the table of crc32 is worked out from its polynomial.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH RECURSIVE crc(b, k, c) AS (
  SELECT b, 0, b FROM range(256) AS r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8
),
steps AS (SELECT list(c ORDER BY b) AS t FROM crc WHERE k = 8),
d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
bw AS (SELECT unnest({WORDS}) AS w FROM benchmark),
words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
coded AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
                            lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)])), 4294967295) % {resampling.BUCKETS} AS bucket
  FROM words, steps
),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN coded USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN coded USING (w) GROUP BY bucket),
gain AS (
  SELECT s.bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + {resampling.BUCKETS}))::DOUBLE
                                        / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + {resampling.BUCKETS}))::DOUBLE)) AS BIGINT) AS g
  FROM s LEFT JOIN t ON t.bucket = s.bucket
),
summed AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN coded USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{resampling.SEED}:' || d.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN summed ON summed.doc_id = d.doc_id
),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {resampling.LEAST_WORDS})
SELECT scored.doc_id, n_features, weight, score, CASE WHEN place <= n * {resampling.PERCENT} // 100 THEN place END AS rank
FROM scored LEFT JOIN placed ON placed.doc_id = scored.doc_id
"""


#: Every string of 100 bytes, cut from parts of 500 places, with its first place; a byte goes if a repeated one starts at it or within 99 bytes before.
OP12_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, len(x) // 2 AS n, p, x[2 * p + 1:2 * (p + 500 + {suffixes.LENGTH})] AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2, 500)) AS p FROM d)),
b AS (SELECT doc_id, p + i AS i, y[2 * i + 1:2 * i + 2] AS byte, md5_number(y[2 * i + 1:2 * (i + {suffixes.LENGTH})]) AS s, p + i + {suffixes.LENGTH} <= n AS whole
      FROM (SELECT *, unnest(range(least(500, n - p))) AS i FROM c)),
f AS (SELECT s, min((doc_id, i)) AS first FROM b WHERE whole GROUP BY s HAVING count(*) > 1),
m AS (SELECT b.*, whole AND coalesce((doc_id, i) > first, false) AS later FROM b LEFT JOIN f USING (s)),
g AS (SELECT doc_id, i, byte, coalesce(i - max(CASE WHEN later THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < {suffixes.LENGTH}, false) AS gone FROM m),
o AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM o GROUP BY doc_id)
SELECT d.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""


OP13_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
totals AS (SELECT count(*) FILTER (len(ws) > 0) AS n_all, CAST(sum(len(ws)) AS BIGINT) AS l_all FROM d),
q AS (SELECT item_id, w, count(*) AS times FROM (SELECT item_id, unnest({WORDS}) AS w FROM benchmark) GROUP BY item_id, w),
p AS (SELECT doc_id, w, n, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM d) SEMI JOIN q USING (w) GROUP BY doc_id, w, n),
f AS (SELECT w, CAST(floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, totals GROUP BY w, n_all),
c AS (SELECT doc_id, w, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // l_all))) AS part FROM p JOIN f USING (w), totals),
s AS (SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM q JOIN c USING (w) GROUP BY item_id, doc_id HAVING sum(times * part) > 0)
SELECT item_id, CAST(row_number() OVER v AS INTEGER) AS rank, doc_id, score FROM s WINDOW v AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= {ranked.TOP}
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_mix_sources": OP3_SQL, "op11_resample": OP11_SQL, "op12_suffix_array": OP12_SQL, "op13_ranked_search": OP13_SQL, "url_rules": URL_RULES_SQL, "quality_counts": QUALITY_COUNTS_SQL}
