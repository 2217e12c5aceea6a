"""Queries over timelines, survival, text, dates and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.catalogue import query, table
from tessella.functions import text, values
from tessella.operators import codes, metadata, models_fit, notes, stats, timeline


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    last = timeline.last_per_key(table(spark, d, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id"))
    return last.select("user_id", "event_type", "event_id", "value")


@query("""
SELECT source, kind, doc_id, conf FROM (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY conf DESC, doc_id) AS n
FROM (SELECT source, quality AS kind, doc_id, round((n_chars % 100) / 100.0, 2)::DOUBLE AS conf FROM labels JOIN documents USING (doc_id))) WHERE n = 1
""")
def conf_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    rows = rows.select("source", F.col("quality").alias("kind"), "doc_id", F.round((F.col("n_chars") % 100) / 100.0, 2).alias("conf"))
    return timeline.most_confident(rows, ["source", "kind"], "conf", "doc_id")


@query("""
SELECT user_id, event_type, event_id, conf FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (conf >= 0.9) DESC, CASE WHEN conf >= 0.9 THEN event_id END, conf DESC, event_id) AS n
FROM (SELECT user_id, event_type, event_id, round((event_id * 37 % 100) / 100.0, 2)::DOUBLE AS conf FROM events)) WHERE n = 1
""")
def conf_merge_locking(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", F.round((F.col("event_id") * 37 % 100) / 100.0, 2).alias("conf"))
    return timeline.locked_merge(rows, ["user_id", "event_type"], "conf", "event_id")


@query("""
SELECT user_id, line, count(*) AS n_events, min(event_id) AS first_event FROM (
  SELECT user_id, event_id, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS line FROM (
    SELECT user_id, event_id, ts, CASE WHEN p IS NULL OR date_diff('microsecond', p, ts) // 1000000 > 86400 THEN 1 ELSE 0 END AS opens
    FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))) GROUP BY 1, 2
""")
def line_of_therapy(spark: SparkSession, d: str) -> DataFrame:
    lines = timeline.lines_of_therapy(table(spark, d, "events"), "user_id", "ts", "event_id", 86_400)
    return lines.groupBy("user_id", "line").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS instance FROM lineitem")
def instance_index(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return timeline.instances(table(spark, d, "lineitem"), ["l_orderkey"], *order).select("l_orderkey", "l_linenumber", "l_partkey", "instance")


@query("""
SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS dr, CAST(ntile(4) OVER k AS INTEGER) AS quarter, lag(o_orderkey) OVER k AS before, lead(o_orderkey) OVER k AS after,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three,
       count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) - DATE '1990-01-01' RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) AS in_month
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), k AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def rank_frames(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("o_custkey")
    w, k = by.orderBy("o_orderpriority"), by.orderBy("o_orderdate", "o_orderkey")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return table(spark, d, "orders").withColumn("day", day).select(
        "o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(k).alias("quarter"), F.lag("o_orderkey").over(k).alias("before"), F.lead("o_orderkey").over(k).alias("after"),
        F.round(F.sum("o_totalprice").over(k.rowsBetween(-2, 0)), 2).alias("last_three"), F.count("*").over(by.orderBy("day").rangeBetween(-30, 0)).alias("in_month"),
    )


KM_SQL = """
WITH s AS (SELECT (CAST(o_orderdate AS DATE) - DATE '1992-01-01') // 30 AS t, o_orderstatus = 'F' AS ev {extra} FROM orders),
e AS (SELECT t, count(*) AS m, count(*) FILTER (ev) AS d FROM s GROUP BY 1),
r AS (SELECT t, d, CAST(sum(m) OVER (ORDER BY t DESC) AS BIGINT) AS n FROM e)
SELECT CAST(t AS INTEGER) AS time, n AS at_risk, d AS events, round(CASE WHEN min(1 - d / n) OVER (ORDER BY t) > 0 THEN exp(sum(CASE WHEN d < n THEN ln(1 - d / n) END) OVER (ORDER BY t)) ELSE 0 END, 9) AS survival FROM r WHERE d > 0
"""


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    months = F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) / 30).cast("int")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", months.alias("t"), (F.col("o_orderstatus") == "F").alias("ev"))


@query(KM_SQL.format(extra=""))
def km_curve(spark: SparkSession, d: str) -> DataFrame:
    return stats.kaplan_meier(_subjects(spark, d), "t", "ev").withColumn("survival", F.round("survival", 9))


@query("""
WITH s AS (SELECT CAST((CAST(o_orderdate AS DATE) - DATE '1992-01-01') // 30 AS INTEGER) AS t, o_orderstatus = 'F' AS ev, CAST((CAST(o_orderdate AS DATE) - DATE '1992-01-01') // 30 - 1 - o_orderkey % 24 AS INTEGER) AS entry FROM orders),
ev AS (SELECT t, count(*) FILTER (ev) AS d FROM s GROUP BY 1 HAVING count(*) FILTER (ev) > 0),
r AS (SELECT ev.t, ev.d, (SELECT count(*) FROM s WHERE s.entry < ev.t AND ev.t <= s.t) AS n FROM ev)
SELECT t AS time, n AS at_risk, d AS events, round(CASE WHEN min(1 - d / n) OVER (ORDER BY t) > 0 THEN exp(sum(CASE WHEN d < n THEN ln(1 - d / n) END) OVER (ORDER BY t)) ELSE 0 END, 9) AS survival FROM r
""")
def km_delayed_entry(spark: SparkSession, d: str) -> DataFrame:
    late = _subjects(spark, d).withColumn("entry", (F.col("t") - 1 - F.col("o_orderkey") % 24).cast("int"))
    return stats.kaplan_meier(late, "t", "ev", "entry").withColumn("survival", F.round("survival", 9))


@query("""
WITH s AS (SELECT CAST((CAST(o_orderdate AS DATE) - DATE '1992-01-01') // 30 AS INTEGER) AS t, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS cause FROM orders),
e AS (SELECT t, count(*) AS m, count(*) FILTER (cause > 0) AS d FROM s GROUP BY 1), r AS (SELECT t, d, sum(m) OVER (ORDER BY t DESC) AS n FROM e),
l AS (SELECT t, n, CASE WHEN coalesce(min(1 - d / n) OVER b, 1) > 0 THEN exp(coalesce(sum(CASE WHEN d < n THEN ln(1 - d / n) END) OVER b, 0)) ELSE 0 END AS s FROM r WINDOW b AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT t, cause, count(*) AS k FROM s WHERE cause > 0 GROUP BY 1, 2)
SELECT t AS time, cause, round(sum(l.s * k / n) OVER (PARTITION BY cause ORDER BY t), 9) AS incidence FROM k JOIN l USING (t)
""")
def cif(spark: SparkSession, d: str) -> DataFrame:
    cause = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(0)
    return stats.cumulative_incidence(_subjects(spark, d).withColumn("cause", cause), "t", "cause").withColumn("incidence", F.round("incidence", 9))


@query("SELECT count(*) AS n_left, CAST(sum(t - 24) AS BIGINT) AS months, count(*) FILTER (ev) AS n_events FROM (SELECT (CAST(o_orderdate AS DATE) - DATE '1992-01-01') // 30 AS t, o_orderstatus = 'F' AS ev FROM orders) WHERE t > 24")
def landmark(spark: SparkSession, d: str) -> DataFrame:
    return stats.landmark(_subjects(spark, d), "t", 24).agg(F.count("*").alias("n_left"), F.sum("t").cast("long").alias("months"), F.count(F.when(F.col("ev"), 1)).alias("n_events"))


@query("""
WITH s AS (SELECT (CAST(o_orderdate AS DATE) - DATE '1992-01-01') // 30 AS t, o_orderstatus FROM orders)
SELECT scenario, count(*) AS n, count(*) FILTER (ev) AS n_events, CAST(max(t) AS INTEGER) AS last_time FROM (
  SELECT 'worst' AS scenario, t, o_orderstatus IN ('F', 'O') AS ev FROM s UNION ALL SELECT 'observed', t, o_orderstatus = 'F' FROM s
  UNION ALL SELECT 'best', CASE WHEN o_orderstatus <> 'F' THEN (SELECT max(t) FROM s) ELSE t END, o_orderstatus = 'F' FROM s) GROUP BY 1
""")
def censor_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    s = _subjects(spark, d)
    end = s.agg(F.max("t")).first()[0]
    scenarios = F.explode(F.array(
        F.struct(F.lit("worst").alias("scenario"), F.col("t"), F.col("o_orderstatus").isin("F", "O").alias("ev")), F.struct(F.lit("observed").alias("scenario"), F.col("t"), F.col("ev")),
        F.struct(F.lit("best").alias("scenario"), F.when(F.col("ev"), F.col("t")).otherwise(F.lit(end)).alias("t"), F.col("ev")),
    ))
    return s.select(scenarios.alias("x")).select("x.*").groupBy("scenario").agg(F.count("*").alias("n"), F.count(F.when(F.col("ev"), 1)).alias("n_events"), F.max("t").alias("last_time"))


@query("""
WITH b AS (SELECT o_custkey, arg_min(s, struct_pack(a := r, b := o_orderkey)) AS best FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'CR' WHEN 'P' THEN 'PR' ELSE 'PD' END AS s, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 4 END AS r FROM orders) GROUP BY 1)
SELECT count(*) AS evaluable, round(count(*) FILTER (best IN ('CR', 'PR')) / count(*), 6) AS orr, round(count(*) FILTER (best IN ('CR', 'PR', 'SD')) / count(*), 6) AS dcr FROM b
""")
def orr_dcr(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    response = F.when(s == "F", "CR").when(s == "P", "PR").otherwise("PD")
    rank = F.when(s == "F", 1).when(s == "P", 2).otherwise(4)
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by(response, F.struct(rank, "o_orderkey")).alias("best"))
    share = lambda *of: F.round(F.count(F.when(F.col("best").isin(*of), 1)) / F.count("*"), 6)
    return best.agg(F.count("*").alias("evaluable"), share("CR", "PR").alias("orr"), share("CR", "PR", "SD").alias("dcr"))


@query("""
WITH c AS (SELECT o_orderstatus a, o_orderpriority b, count(*)::DOUBLE n FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(n) ra FROM c GROUP BY 1), k AS (SELECT b, sum(n) cb FROM c GROUP BY 1)
SELECT round(sum(n) * (sum(n * n / (ra * cb)) - 1), 6) AS chi_square, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS degrees FROM c JOIN r USING (a) JOIN k USING (b)
""")
def chi_square(spark: SparkSession, d: str) -> DataFrame:
    return stats.crosstab_statistic(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").withColumn("chi_square", F.round("chi_square", 6))


@query("""
WITH r AS (SELECT l_returnflag = 'R' AS g, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS mid FROM lineitem)
SELECT round(sum(mid) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2, 1) AS u, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2 FROM r
""")
def mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    return stats.mann_whitney(table(spark, d, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R").withColumn("u", F.round("u", 1))


@query("""
WITH s AS (SELECT c_acctbal > 5000 AS tr, greatest(least((c_custkey % 100) / 100.0, 0.99), 0.01)::DOUBLE AS p FROM customer), w AS (SELECT CASE WHEN tr THEN 1 / p ELSE 1 / (1 - p) END AS w FROM s)
SELECT round(min(w), 6) AS least, round(max(w), 6) AS largest, round(avg(w), 6) AS mean, round(median(w), 6) AS median FROM w
""")
def iptw(spark: SparkSession, d: str) -> DataFrame:
    weighted = stats.inverse_weights(table(spark, d, "customer"), F.col("c_acctbal") > 5000, ((F.col("c_custkey") % 100) / F.lit(100.0)).cast("double"))
    return weighted.agg(F.round(F.min("weight"), 6).alias("least"), F.round(F.max("weight"), 6).alias("largest"), F.round(F.avg("weight"), 6).alias("mean"), F.round(F.median("weight"), 6).alias("median"))


@query("""
WITH t AS (SELECT count(*) FILTER (e AND o)::DOUBLE a, count(*) FILTER (e AND NOT o)::DOUBLE b, count(*) FILTER (NOT e AND o)::DOUBLE c, count(*) FILTER (NOT e AND NOT o)::DOUBLE d FROM (SELECT l_returnflag = 'R' AS e, l_discount > 0.05 AS o FROM lineitem))
SELECT a, b, c, d, round(a * d / (b * c), 6) AS odds_ratio, round(exp(ln(a * d / (b * c)) - 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS lower, round(exp(ln(a * d / (b * c)) + 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS upper FROM t
""")
def odds_ratio(spark: SparkSession, d: str) -> DataFrame:
    out = stats.odds_ratio(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", F.col("l_discount") > 0.05)
    return out.withColumns({c: F.round(c, 6) for c in ("odds_ratio", "lower", "upper")})


@query("""
WITH p AS (SELECT p_partkey, ((p_partkey * 7919) % 1000 + 1) / 1000.0::DOUBLE AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS k, count(*) OVER () AS n FROM p)
SELECT p_partkey, round(min(least(p * n / k, 1)) OVER (ORDER BY k DESC), 9) AS adjusted FROM r
""")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (((F.col("p_partkey") * 7919) % 1000 + 1) / F.lit(1000.0)).cast("double").alias("p"))
    return stats.adjusted_p(p, "p").select("p_partkey", F.round("adjusted", 9).alias("adjusted"))


@query("""
WITH x AS (SELECT unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT i, median(x) AS m FROM x GROUP BY 1)
SELECT CAST(i AS INTEGER) AS dimension, round(median(abs(x - m)), 9) AS mad FROM x JOIN m USING (i) GROUP BY 1 ORDER BY median(abs(x - m)) DESC, 1 LIMIT 10
""")
def mad_topk(spark: SparkSession, d: str) -> DataFrame:
    return stats.deviation_of_dimensions(table(spark, d, "embeddings"), "embedding", 10).withColumn("mad", F.round("mad", 9))


@query("""
WITH x AS (SELECT vec_id, abs(CAST(unnest(embedding) AS DOUBLE)) AS a FROM embeddings), t AS (SELECT vec_id, sum(a) AS total FROM x GROUP BY 1)
SELECT vec_id, round(total, 4) AS total, round(sum(ln(1 + 10000 * a / total)), 4) AS log_total FROM x JOIN t USING (vec_id) GROUP BY vec_id, total
""")
def vector_norm(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v).cast("double")).alias("a"))
    added = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    sums = sizes.withColumn("whole", added("a"))
    return sums.select("vec_id", F.round("whole", 4).alias("total"), F.round(added(F.transform("a", lambda v: F.log1p(F.lit(10000.0) * v / F.col("whole")))), 4).alias("log_total"))


@query("""
SELECT doc_id, CASE WHEN c < 0.9 AND crit THEN 'CRITICAL' WHEN c < 0.7 AND NOT crit AND req THEN 'HIGH' WHEN c < 0.5 THEN 'LOW' END AS priority, c AS confidence
FROM (SELECT doc_id, lang = 'de' AS crit, lang IN ('fr', 'es') AS req, round((n_chars % 100) / 100.0, 2)::DOUBLE AS c FROM labels JOIN documents USING (doc_id)) WHERE CASE WHEN c < 0.9 AND crit THEN 1 WHEN c < 0.7 AND req THEN 2 WHEN c < 0.5 THEN 3 END IS NOT NULL
""")
def review_triage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", "lang", F.round((F.col("n_chars") % 100) / 100.0, 2).alias("confidence"))
    rank = F.when(F.col("priority") == "CRITICAL", 0).when(F.col("priority") == "HIGH", 1).otherwise(3)
    queue = rows.select("doc_id", values.triage(F.col("lang"), F.col("confidence"), ["de"], ["fr", "es"]).alias("priority"), "confidence").filter("priority is not null")
    return queue.orderBy(rank, "confidence", "doc_id")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, lower(o_orderpriority) AS low, upper(trim('  ' || o_orderpriority || ' ')) AS up FROM orders")
def value_map(spark: SparkSession, d: str) -> DataFrame:
    recoded = text.value_map(F.col("o_orderstatus"), {"F": "final", "O": "open"})
    up = values.TRANSFORMS["uppercase"](values.TRANSFORMS["strip"](F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))))
    return table(spark, d, "orders").select("o_orderkey", recoded.alias("status"), values.TRANSFORMS["lowercase"](F.col("o_orderpriority")).alias("low"), up.alias("up"))


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(n, '^[0-9]') THEN 't_' || n WHEN n = '' THEN 'unknown' ELSE n END AS table_name, regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS column_name
FROM (SELECT *, regexp_replace(replace(replace(regexp_replace(lower(trim(raw)), '^cancer_', ''), '_therapy_regimen', ''), '_therapy', ''), '[^\\p{L}\\p{N}]', '_', 'g') AS n
      FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'Cancer_' || p_type || '_therapy_regimen' WHEN 1 THEN p_size || ' ' || p_name ELSE p_brand || '_therapy' END AS raw FROM part))
""")
def table_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("Cancer_"), "p_type", F.lit("_therapy_regimen"))).when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name")).otherwise(F.concat("p_brand", F.lit("_therapy")))
    return table(spark, d, "part").select("p_partkey", text.table_name(raw).alias("table_name"), text.column_name(F.concat("p_brand", F.lit(" / "), "p_type")).alias("column_name"))


@query("SELECT doc_id, CASE WHEN lower(trim(x)) IN ('', 'nan', 'none', 'nat') THEN NULL ELSE trim(x) END AS cleaned FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' NaN' WHEN 1 THEN '  ' WHEN 2 THEN 'None' WHEN 3 THEN ' ' || source ELSE lang END AS x FROM documents)")
def clean_scalar(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, " NaN").when(k == 1, "  ").when(k == 2, "None").when(k == 3, F.concat(F.lit(" "), "source")).otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", text.clean_scalar(raw).alias("cleaned"))


@query("""
SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b')) AS n_emails, md5(regexp_replace(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b', '[EMAIL]', 'g')) AS redacted FROM documents
""")
def email_redaction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(text.EMAIL)).cast("long").alias("n_emails"), F.md5(F.regexp_replace("text", text.EMAIL, "[EMAIL]").cast("binary")).alias("redacted"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '(^|[^\\p{L}\\p{N}_])with($|[^\\p{L}\\p{N}_])') THEN 'english' WHEN regexp_matches(text, '(^|[^\\p{L}\\p{N}_])und($|[^\\p{L}\\p{N}_])') THEN 'german' WHEN regexp_matches(text, '(^|[^\\p{L}\\p{N}_])que($|[^\\p{L}\\p{N}_])') THEN 'romance' END AS first_hit,
       CAST(regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])the($|[^\\p{L}\\p{N}_])') AS INTEGER) + CAST(regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])der($|[^\\p{L}\\p{N}_])') AS INTEGER) + CAST(regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])los($|[^\\p{L}\\p{N}_])') AS INTEGER) AS n_found FROM documents
""")
def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    first = text.first_keyword(F.col("text"), [(r"\bwith\b", "english"), (r"\bund\b", "german"), (r"\bque\b", "romance")])
    return table(spark, d, "documents").select("doc_id", first.alias("first_hit"), F.size(text.keywords_found(F.col("text"), ["the", "der", "los"])).alias("n_found"))


@query("""
SELECT doc_id, CAST((pos - 1) // 3 AS INTEGER) AS batch, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents) GROUP BY 1, 2
""")
def split_explode(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.groupBy("doc_id", F.floor(F.col("pos") / 3).cast("int").alias("batch")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("""
SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(raw)), '(?i)\\b(cancer|carcinoma|tumor|tumour|neoplasm|malignancy|malignant)\\b', '', 'g'), '\\s+', ' ', 'g')) AS normal,
       CASE WHEN site IN ('C50', 'C34') THEN CASE site WHEN 'C50' THEN 'breast' ELSE 'lung' END WHEN site = 'C44' THEN CASE WHEN h BETWEEN 8720 AND 8790 THEN 'melanoma' ELSE 'generic' END
            WHEN h BETWEEN 9731 AND 9734 THEN 'myeloma' WHEN h BETWEEN 9590 AND 9729 THEN 'lymphoma' WHEN h BETWEEN 9800 AND 9948 THEN 'leukemia' ELSE 'generic' END AS schema_name
FROM (SELECT p_partkey, p_type || '  Carcinoma of ' || p_name || ' tumor' AS raw, CASE p_partkey % 4 WHEN 0 THEN 'C50' WHEN 1 THEN 'C34' WHEN 2 THEN 'C44' ELSE 'C77' END AS site, 8700 + (p_partkey * 13) % 1300 AS h FROM part)
""")
def icdo_normalise(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    site = F.when(k == 0, "C50.1").when(k == 1, "C34.9").when(k == 2, "C44.3").otherwise("C77.0")
    histology = F.concat((8700 + (F.col("p_partkey") * 13) % 1300).cast("string"), F.lit("/3"))
    raw = F.concat("p_type", F.lit("  Carcinoma of "), "p_name", F.lit(" tumor"))
    return table(spark, d, "part").select("p_partkey", text.tumor_text(raw).alias("normal"), codes.schema_of(site, histology, {"C50": "breast", "C34": "lung", "C44": "melanoma"}).alias("schema_name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 3 THEN CAST(year(o_orderdate) AS VARCHAR) || '-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def date_parse_mix(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(at, "yyyyMMdd")).when(k == 1, F.date_format(at, " yyyy-MM-dd")).when(k == 2, F.date_format(at, "MM/dd/yyyy")).when(k == 3, F.date_format(at, "yyyy")).otherwise("13/45/x")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(values.mixed_date(raw), "yyyy-MM-dd").alias("day"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(date_diff('microsecond', o_orderdate, l_shipdate) / (86400e6 * 365.25), 9) AS fractional, round(date_diff('day', o_orderdate, l_shipdate) / 365.25, 9) AS whole_days, CAST(year(l_shipdate) AS INTEGER) AS ship_year
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
""")
def years_between(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    later, earlier = F.col("l_shipdate"), F.col("o_orderdate")
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(values.years_fractional(later, earlier), 9).alias("fractional"), F.round(values.years_whole_days(later, earlier), 9).alias("whole_days"), F.year(later).alias("ship_year"),
    )


@query("""
SELECT 'o_orderdate' AS column_name, 1.0::DOUBLE AS share, true AS is_date FROM (SELECT 1) UNION ALL
SELECT 'mixed', round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END), 6), avg(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END) > 0.5 FROM orders UNION ALL SELECT 'o_orderstatus', 0.0, false
""")
def date_detect(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    looks = {"o_orderdate": day, "mixed": F.when(F.col("o_orderkey") % 3 == 0, "soon").otherwise(day), "o_orderstatus": F.col("o_orderstatus")}
    shares = table(spark, d, "orders").agg(*(F.round(F.avg(F.try_to_timestamp(c).isNotNull().cast("int")), 6).alias(n) for n, c in looks.items()))
    return shares.unpivot([], list(looks), "column_name", "share").withColumn("is_date", F.col("share") > 0.5)


@query("""
SELECT o_orderkey, s AS shift, strftime(CAST(o_orderdate AS DATE) + CAST(s AS INTEGER), '%Y-%m-%d') AS moved
FROM (SELECT *, CAST(('0x' || substr(sha256('salt||' || o_custkey || '||date_shift'), 1, 16))::UHUGEINT % 361 AS INTEGER) - 180 AS s FROM orders)
""")
def date_shift_stable(spark: SparkSession, d: str) -> DataFrame:
    shift = values.stable_shift(180, F.lit("salt"), F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", shift.alias("shift"), values.shifted_date(F.date_format("o_orderdate", "yyyy-MM-dd"), shift).alias("moved"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN a > 89 THEN 'seen at age 90+' ELSE 'seen at age ' || a END WHEN a > 89 THEN '90+' ELSE CAST(a AS VARCHAR) END AS age
FROM (SELECT *, p_size * 2 AS a FROM part)
""")
def age_cap(spark: SparkSession, d: str) -> DataFrame:
    aged = table(spark, d, "part").withColumn("a", F.col("p_size") * 2)
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("seen at age "), F.col("a").cast("string"))).otherwise(F.col("a").cast("double").cast("string"))
    return aged.select("p_partkey", values.capped_age(raw).alias("age"))


@query("""
SELECT doc_id, round(CASE WHEN r > 0 THEN least(m, r) ELSE m * 0.5 END, 4) AS confidence, round(m * 0.8, 4) AS seeded FROM (SELECT doc_id, ((doc_id * 31) % 101) / 100.0::DOUBLE AS m, (quality * ((doc_id * 17) % 100)) / 100.0::DOUBLE AS r FROM labels)
""")
def conf_combine(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "labels").select("doc_id", (((F.col("doc_id") * 31) % 101) / F.lit(100.0)).alias("m"), (F.col("quality") * ((F.col("doc_id") * 17) % 100) / F.lit(100.0)).alias("r"))
    return scores.select("doc_id", values.combined_confidence(F.col("m"), F.col("r")).alias("confidence"), F.round(F.col("m") * 0.8, 4).alias("seeded"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(DISTINCT json_extract_string(props, '$.k')) AS n_keys FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = values.unwrapped(F.col("props"), "k")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k.try_cast("long")).alias("total"), F.countDistinct(k).alias("n_keys"))


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1")
def array_join_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "; ").alias("flags"))


@query("""
SELECT doc_id, CASE WHEN trim(t) = '' THEN 'empty_text' END AS error, substr(t, 1, 300) AS evidence, CASE WHEN length(t) > 100 THEN substr(t, 1, 50) || ' ... ' || substr(t, length(t) - 49) ELSE t END AS preview
FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '   ' ELSE text END AS t FROM documents)
""")
def empty_text_flag(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "   ").otherwise(F.col("text")).alias("t"))
    return docs.select("doc_id", F.when(F.trim("t") == "", "empty_text").alias("error"), F.substring("t", 1, 300).alias("evidence"), text.middle_cut(F.col("t"), 100).alias("preview"))


@query("""
SELECT doc_id, regexp_matches(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b') OR regexp_matches(text, '\\b(?:Mr|Ms|Mrs|Miss)\\.?\\s+[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?\\b') AS review FROM documents
""")
def phi_review_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.needs_review(F.col("text"), (text.EMAIL, text.HONORIFIC)).alias("review"))


@query("SELECT o_orderkey, CAST(coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END, DATE '2001-12-31') AS VARCHAR) AS followed, TRY_CAST(substr(o_orderpriority, 1, CAST(1 + o_orderkey % 2 AS INTEGER)) AS DOUBLE) AS number FROM orders")
def default_followup(spark: SparkSession, d: str) -> DataFrame:
    end = F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date")), F.lit("2001-12-31").cast("date"))
    cut = F.substr("o_orderpriority", F.lit(1), (1 + F.col("o_orderkey") % 2).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", end.cast("string").alias("followed"), values.numeric(cut).alias("number"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5(F.col("text").cast("binary")).alias("md"))


@query("SELECT coalesce(category, 'other') AS category, count(*) AS n_rows, count(DISTINCT event_type) AS n_fields FROM events LEFT JOIN (VALUES ('view', 'browse'), ('click', 'browse'), ('purchase', 'trade')) f(field, category) ON field = event_type GROUP BY 1")
def flat_to_category(spark: SparkSession, d: str) -> DataFrame:
    fields = {"view": "browse", "click": "browse", "purchase": "trade"}
    category = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in fields.items() for x in p)), F.col("event_type")), F.lit("other"))
    return table(spark, d, "events").groupBy(category.alias("category")).agg(F.count("*").alias("n_rows"), F.countDistinct("event_type").alias("n_fields"))


@query("""
SELECT l_returnflag, printf('%.1f [%.1f-%.1f]', median(l_quantity), quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.75)) AS quantity, printf('%d (%.1f%%)', count(*), 100.0 * count(*) / (SELECT count(*) FROM lineitem)) AS share FROM lineitem GROUP BY 1
""")
def format_iqr(spark: SparkSession, d: str) -> DataFrame:
    q = lambda p: F.percentile("l_quantity", F.lit(p))
    by = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.format_string("%.1f [%.1f-%.1f]", q(0.5), q(0.25), q(0.75)).alias("quantity"), F.count("*").alias("n"))
    share = (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).cast("double")
    return by.select("l_returnflag", "quantity", F.format_string("%d (%.1f%%)", F.col("n"), share).alias("share"))


@query("""
SELECT CASE WHEN event_type IN ('signup', 'error') THEN -1 ELSE user_id % 3 END AS tumor, event_type, count(*) AS n_rows FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'view') GROUP BY 1, 2
""")
def level_split_append(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    appended = events.unionByName(events.filter("event_type = 'view'"))
    level = F.when(F.col("event_type").isin("signup", "error"), -1).otherwise(F.col("user_id") % 3)
    return appended.groupBy(level.alias("tumor"), "event_type").agg(F.count("*").alias("n_rows"))


@query("SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^[0-9]{3,}'))) > 0 AS has_number, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_parts FROM documents")
def any_match_array(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", F.exists(parts, lambda x: x.rlike("^[0-9]{3,}")).alias("has_number"), F.size(parts).alias("n_parts"))


@query("""
SELECT doc_id, CAST(i AS INTEGER) AS chunk, substr(text, CAST(i AS BIGINT) * 900 + 1, 1000) AS piece
FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 1000 THEN 1 ELSE CAST(ceil((length(text) - 1000) / 900) AS BIGINT) + 1 END)) AS i FROM documents WHERE length(text) > 0)
""")
def chunk_chars(spark: SparkSession, d: str) -> DataFrame:
    pieces = timeline.chunked(F.col("text"), 1000, 100)
    return table(spark, d, "documents").select("doc_id", F.posexplode(pieces).alias("chunk", "piece"))


@query("""
WITH s AS (SELECT avg(l_quantity) FILTER (g) m1, var_samp(l_quantity) FILTER (g) v1, count(*) FILTER (g)::DOUBLE n1, avg(l_quantity) FILTER (NOT g) m2, var_samp(l_quantity) FILTER (NOT g) v2, count(*) FILTER (NOT g)::DOUBLE n2
           FROM (SELECT l_quantity, l_returnflag = 'R' AS g FROM lineitem))
SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)), 2) AS degrees FROM s
""")
def t_test(spark: SparkSession, d: str) -> DataFrame:
    return models_fit.welch(table(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R").select(F.round("t", 6).alias("t"), F.round("degrees", 2).alias("degrees"))


@query("""
SELECT user_id, field, arg_min(event_id, CASE WHEN tumor = -1 THEN 1073741824 ELSE tumor END) AS value
FROM (SELECT user_id, event_type AS field, CAST(event_id % 5 - 1 AS INTEGER) AS tumor, min(event_id) AS event_id FROM events GROUP BY ALL) GROUP BY 1, 2
""")
def registry_dict(spark: SparkSession, d: str) -> DataFrame:
    tumor = (F.col("event_id") % 5 - 1).cast("int")
    rows = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("field"), tumor.alias("tumor_index")).agg(F.min("event_id").alias("value"))
    return notes.registry_values(rows, "user_id")


@query("""
SELECT vec_id, CAST(n AS INTEGER) AS n_genes, round(share, 6) AS share FROM (
  SELECT vec_id, count(*) FILTER (v > 0) AS n, coalesce(sum(v) FILTER (i <= 3), 0) / sum(v) AS share
  FROM (SELECT vec_id, greatest(CAST(unnest(embedding) AS DOUBLE), 0) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1) WHERE n >= 25 AND share <= 0.1
""")
def cell_qc(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0))).alias("counts"))
    return models_fit.cell_quality(cells, "vec_id", "counts", [0, 1, 2], 25, 0.1).withColumn("share", F.round("share", 6))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'What is the stage?' WHEN 1 THEN 'Any drug?' ELSE 'Stage' END AS question
FROM part WHERE p_partkey % 4 <> 3
""")
def qa_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    key = F.when(F.col("p_partkey") % 4 == 3, "_meta").when(k == 0, "what is the STAGE?").when(k == 1, "Q2: any drug? ").otherwise("Stage")
    questions = spark.createDataFrame([("What is the stage?", 0), ("Any drug?", 1), ("Stage", 2)], "question string, place int")
    return notes.answers_by_question(table(spark, d, "part").select("p_partkey", key.alias("key")), questions).select("p_partkey", "question")


@query("SELECT l_orderkey, CAST(pos // 3 AS INTEGER) AS batch, count(*) AS n_rows FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem) GROUP BY 1, 2")
def batch_split(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    placed = timeline.instances(table(spark, d, "lineitem"), ["l_orderkey"], *order)
    return notes.batches(placed, "instance", 3).groupBy("l_orderkey", "batch").agg(F.count("*").alias("n_rows"))


@query("""
WITH c AS (SELECT 'c_mktsegment' AS column_name, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS k FROM c WHERE value IS NOT NULL)
SELECT column_name, value, CASE WHEN n < 10 THEN '<10' ELSE CAST(n AS VARCHAR) END AS n_rows FROM r WHERE k <= 15
""")
def metadata_categorical(spark: SparkSession, d: str) -> DataFrame:
    return metadata.categorical_summary(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])


@query("""
SELECT DISTINCT o_custkey, o_orderstatus AS field FROM orders WHERE (o_custkey, o_orderstatus) NOT IN (SELECT (o_custkey, o_orderstatus) FROM orders WHERE (o_orderkey % 100) / 100.0 >= 0.9)
""")
def open_fields(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("field"), ((F.col("o_orderkey") % 100) / F.lit(100.0)).alias("confidence"))
    return timeline.open_fields(results.select("o_custkey", "field").distinct(), results, ["o_custkey", "field"], "confidence")
