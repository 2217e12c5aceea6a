"""Queries over sources, projections, joins, aggregates and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.catalogue import query, table
from tessella.functions import text, values
from tessella.operators import codes, cohort, deid, privacy, stats, timeline
from tessella.plans import gate
from tessella.sources import tables


@query("""
SELECT c_mktsegment AS segment, c_nationkey AS nation, CASE WHEN n < 12 THEN '<12' ELSE CAST(n AS VARCHAR) END AS n_patients,
       CASE WHEN n < 12 THEN 'suppressed' ELSE CAST(CAST(r AS BIGINT) AS VARCHAR) END AS high_rate
FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n, floor(100.0 * count(*) FILTER (c_acctbal > 5000) / count(*)) AS r FROM customer GROUP BY ALL)
""")
def cell_suppression(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).agg(
        F.count("*").alias("n_patients"), F.floor(100.0 * F.count(F.when(F.col("c_acctbal") > 5000, 1)) / F.count("*")).alias("high_rate")
    )
    return privacy.suppressed(grouped, 12)


@query("""
SELECT seg, CASE WHEN n_patients < 10 THEN '<10' ELSE CAST(n_patients AS VARCHAR) END AS n_patients
FROM (SELECT c_mktsegment AS seg, count(*) AS n_patients FROM customer GROUP BY 1)
""")
def gated_sql(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "customer").createOrReplaceTempView("gate_customer")
    asked = "WITH p AS (SELECT c_mktsegment AS seg, c_custkey FROM gate_customer) SELECT seg, count(c_custkey) AS n_patients FROM p GROUP BY seg"
    return gate.answer(spark, asked, protected=("c_custkey",)).data


@query("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_patients FROM orders")
def count_distinct_patients(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("n_patients"))


@query("""
SELECT 'customer' AS table_name, count(*) AS n_rows, 5 AS n_columns, count(DISTINCT c_custkey) AS n_patients FROM customer
UNION ALL SELECT 'orders', count(*), 6, count(DISTINCT o_custkey) FROM orders
""")
def database_summary(spark: SparkSession, d: str) -> DataFrame:
    return tables.summaries({"customer": table(spark, d, "customer").withColumnRenamed("c_custkey", "record_id"), "orders": table(spark, d, "orders").withColumnRenamed("o_custkey", "record_id")})


@query("SELECT source, count(*) AS n_rows FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def topk_freq(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_values(table(spark, d, "documents"), "source")


@query("""
SELECT c AS column_name, count(v) AS n_values, min(v) AS least, max(v) AS largest, round(avg(v), 4) AS mean, median(v) AS median,
       quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
FROM (SELECT 'l_quantity' AS c, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem)
GROUP BY 1
""")
def profile_five_num(spark: SparkSession, d: str) -> DataFrame:
    return stats.five_numbers(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"]).withColumn("mean", F.round("mean", 4))


@query("""
WITH j AS (SELECT o_orderkey, o_custkey, l_discount, l_tax FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 7) l ON o_orderkey = l_orderkey)
SELECT 'o_orderkey' AS column_name, count(o_orderkey) AS n_values FROM j UNION ALL SELECT 'o_custkey', count(o_custkey) FROM j
UNION ALL SELECT 'l_discount', count(l_discount) FROM j UNION ALL SELECT 'l_tax', count(l_tax) FROM j
""")
def nonnull_counts(spark: SparkSession, d: str) -> DataFrame:
    sparse = table(spark, d, "lineitem").filter("l_linenumber = 7")
    joined = table(spark, d, "orders").join(sparse, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return cohort.nonnull_counts(joined.select("o_orderkey", "o_custkey", "l_discount", "l_tax"))


@query("SELECT c_custkey AS patient_key FROM customer UNION SELECT o_custkey FROM orders")
def distinct_ids_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("patient_key"))
    return a.union(table(spark, d, "orders").select("o_custkey")).distinct()


@query("""
SELECT conv_id, string_agg('--- ' || role || ' | ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS text, count(*) AS n_notes
FROM conversations WHERE length(text) >= 10 GROUP BY 1
""")
def concat_notes(spark: SparkSession, d: str) -> DataFrame:
    header = F.concat(F.lit("--- "), "role", F.lit(" | "), F.col("turn").cast("string"), F.lit(" ---"))
    return timeline.concatenated_notes(table(spark, d, "conversations"), "conv_id", ["turn", "role", "text"], header, "text")


@query("SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def category_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users"))


@query("""
SELECT lang, count(*) AS n_documents, CAST(sum(n_chars) AS BIGINT) AS n_chars, round(CAST(sum(n_chars) AS DOUBLE) / greatest(count(*), 1), 1) AS avg_chars
FROM documents GROUP BY 1
""")
def scenario_stats(spark: SparkSession, d: str) -> DataFrame:
    total = F.sum("n_chars")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_documents"), total.alias("n_chars"), F.round(total.cast("double") / F.greatest(F.count("*"), F.lit(1)), 1).alias("avg_chars"))


@query("""
SELECT CASE WHEN event_type = 'purchase' THEN 'EXFILTRATED' WHEN value IS NULL THEN 'ERROR' WHEN value < 10 THEN 'BLOCKED' ELSE 'REFUSED' END AS outcome,
       count(*) AS n_runs, round(100.0 * count(*) / (SELECT count(*) FROM events), 1) AS pct
FROM events GROUP BY 1
""")
def outcome_rate(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "purchase", "EXFILTRATED").when(F.col("value").isNull(), "ERROR").when(F.col("value") < 10, "BLOCKED").otherwise("REFUSED")
    counts = table(spark, d, "events").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n_runs"))
    # The window runs over one row for each outcome.
    return counts.withColumn("pct", F.round(100.0 * F.col("n_runs") / F.sum("n_runs").over(Window.partitionBy()), 1))


@query("""
WITH s AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS v FROM lineitem GROUP BY 1),
j AS (SELECT CASE WHEN abs(v - o_totalprice) / abs(o_totalprice) <= 0.10 THEN 'MATCH' WHEN abs(v - o_totalprice) / abs(o_totalprice) <= 0.20 THEN 'MINOR' ELSE 'MAJOR' END AS status
      FROM orders JOIN s ON o_orderkey = l_orderkey WHERE o_totalprice <> 0)
SELECT status, count(*) AS n_values, round(100.0 * count(*) / (SELECT count(*) FROM j), 1) AS pct FROM j GROUP BY 1
""")
def concordance(spark: SparkSession, d: str) -> DataFrame:
    computed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("v"))
    both = table(spark, d, "orders").filter("o_totalprice <> 0").join(computed, F.col("o_orderkey") == F.col("l_orderkey"))
    counts = both.groupBy(stats.concordance(F.col("o_totalprice"), F.col("v")).alias("status")).agg(F.count("*").alias("n_values"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n_values") / F.sum("n_values").over(Window.partitionBy()), 1))


@query("""
SELECT coalesce(event_type, 'all') AS question, coalesce(CASE WHEN flag THEN 'high' WHEN NOT flag THEN 'low' END, 'all') AS status, count(*) AS n_answers
FROM (SELECT event_type, coalesce(value, 0) >= 50 AS flag FROM events) GROUP BY ROLLUP (event_type, flag)
""")
def verification_rollup(spark: SparkSession, d: str) -> DataFrame:
    flagged = table(spark, d, "events").select("event_type", F.when(F.coalesce("value", F.lit(0)) >= 50, "high").otherwise("low").alias("status"))
    counts = flagged.rollup(F.col("event_type").alias("question"), "status").agg(F.count("*").alias("n_answers"))
    return counts.fillna("all", ["question", "status"])


@query("""
SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(grouping(o_orderstatus) AS INTEGER) AS all_status, CAST(grouping(o_orderpriority) AS INTEGER) AS all_priority, count(*) AS n_rows
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return orders.cube("status", "priority").agg(F.grouping("status").cast("int").alias("all_status"), F.grouping("priority").cast("int").alias("all_priority"), F.count("*").alias("n_rows"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n_rows, round(sum(l_quantity), 2) AS quantity FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())
""")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = [[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")], []]
    return table(spark, d, "lineitem").groupingSets(sets, "l_returnflag", "l_linestatus").agg(F.count("*").alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1
""")
def pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).count().fillna(0)


@query("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_patients, count(*) = count(DISTINCT o_custkey) AS one_row_each FROM orders")
def one_row_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("n_patients")).withColumn("one_row_each", F.col("n_rows") == F.col("n_patients"))


@query("""
SELECT round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sd_pop, round(var_samp(l_discount), 8) AS var_s, round(var_pop(l_discount), 8) AS var_p,
       round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, round(covar_samp(l_quantity, l_extendedprice), 2) AS cs,
       round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
       CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay,
       round(regr_sxx(l_extendedprice, l_quantity), 0) AS sxx, round(regr_sxy(l_extendedprice, l_quantity) / 1e6, 2) AS sxy, round(regr_syy(l_extendedprice, l_quantity) / 1e9, 2) AS syy,
       quantile_disc(l_quantity, 0.3) AS q30
FROM lineitem
""")
def aggregate_surface_stats(spark: SparkSession, d: str) -> DataFrame:
    x, y = "l_quantity", "l_extendedprice"
    r = F.round
    return table(spark, d, "lineitem").agg(
        r(F.stddev(x), 6).alias("sd"), r(F.stddev_pop(x), 6).alias("sd_pop"), r(F.var_samp("l_discount"), 8).alias("var_s"), r(F.var_pop("l_discount"), 8).alias("var_p"),
        r(F.corr(x, y), 6).alias("r"), r(F.covar_pop(x, y), 2).alias("cp"), r(F.covar_samp(x, y), 2).alias("cs"), r(F.regr_slope(y, x), 4).alias("slope"),
        r(F.regr_intercept(y, x), 2).alias("intercept"), r(F.regr_r2(y, x), 6).alias("r2"), F.regr_count(y, x).alias("n"), r(F.regr_avgx(y, x), 6).alias("ax"),
        r(F.regr_avgy(y, x), 4).alias("ay"), r(F.regr_sxx(y, x), 0).alias("sxx"), r(F.regr_sxy(y, x) / 1e6, 2).alias("sxy"), r(F.regr_syy(y, x) / 1e9, 2).alias("syy"),
        F.expr("percentile_disc(0.3) WITHIN GROUP (ORDER BY l_quantity)").alias("q30"),
    )


@query("""
SELECT event_type, bool_and(value >= 0) AS all_positive, bool_or(value > 99) AS some_high, bit_and(user_id) AS ba, bit_or(user_id) AS bo, bit_xor(user_id) AS bx,
       arg_min(event_id, struct_pack(a := ts, b := event_id)) AS first_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS last_id, string_agg(DISTINCT substr(CAST(ts AS VARCHAR), 1, 7), ',' ORDER BY substr(CAST(ts AS VARCHAR), 1, 7)) AS months
FROM events GROUP BY 1
""")
def aggregate_surface_misc(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("event_type").agg(
        F.bool_and(F.col("value") >= 0).alias("all_positive"), F.bool_or(F.col("value") > 99).alias("some_high"), F.bit_and("user_id").alias("ba"), F.bit_or("user_id").alias("bo"), F.bit_xor("user_id").alias("bx"),
        F.min_by("event_id", at).alias("first_id"), F.max_by("event_id", at).alias("last_id"),
        F.array_join(F.array_sort(F.collect_set(F.date_format("ts", "yyyy-MM"))), ",").alias("months"),
    )


@query("""
SELECT round((SELECT entropy(event_type) FROM events), 6) AS entropy, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS histogram
FROM (SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1)
""")
def histogram_entropy(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").filter("event_type is not null").groupBy("event_type").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    bits = F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)
    entries = F.array_sort(F.collect_list(F.concat("event_type", F.lit("="), F.col("n").cast("string"))))
    return counts.agg(F.round(bits, 6).alias("entropy"), F.array_join(entries, ",").alias("histogram"))


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, n_name) AS label, n_regionkey AS region, s.n_suppliers
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey
""")
def left_fill_join(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), "c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("label"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("region"))
    suppliers = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("n_suppliers"))
    return cohort.fill_join(base, [nations, suppliers], "key").select("c_custkey", "label", "region", "n_suppliers")


@query("""
SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND regexp_matches(o_orderpriority, '1-U|2-H'))
""")
def semi_filter(spark: SparkSession, d: str) -> DataFrame:
    urgent = cohort.matching(table(spark, d, "orders"), "o_orderpriority", ["1-U", "2-H"])
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_pending(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return cohort.pending(table(spark, d, "customer").select("c_custkey"), done, "c_custkey")


@query("""
SELECT o_orderkey, CASE WHEN c_custkey % 5 <> 0 THEN 'P' || c_custkey END AS mapped FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON CAST(o_custkey AS VARCHAR) = CAST(c_custkey AS VARCHAR)
""")
def idmap_join(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("mapped"))
    return cohort.mapped_ids(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey", "mapped").select("o_orderkey", "mapped")


@query("""
SELECT d.source, k.word, count(*) AS n_documents FROM documents d, (VALUES ('the'), ('und'), ('que'), ('Licensed under')) k(word) WHERE contains(d.text, k.word) GROUP BY 1, 2
""")
def theta_join(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame([("the",), ("und",), ("que",), ("Licensed under",)], "word string")  # four rows
    docs = table(spark, d, "documents")
    return docs.join(F.broadcast(words), F.contains("text", "word")).groupBy("source", "word").agg(F.count("*").alias("n_documents"))


@query("""
SELECT coalesce(a.k, b.k) AS nation, coalesce(n_suppliers, 0) AS n_suppliers, coalesce(n_customers, 0) AS n_customers
FROM (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer GROUP BY 1) b ON a.k = b.k
""")
def full_outer(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_customers"))
    return a.join(b, "nation", "full").fillna(0, ["n_suppliers", "n_customers"])


@query("""
SELECT e.event_id, (SELECT arg_max(p.value, struct_pack(a := p.ts, b := p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'view' AND p.ts < e.ts) AS seen
FROM events e WHERE e.event_type = 'purchase'
""")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    # One value for each user and instant, so that ties at an instant are settled before the walk.
    views = events.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max_by(F.struct("value"), F.struct("event_id")).alias("v")).select("user_id", "ts", "v.value")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return timeline.as_of(bought, views, "user_id", "ts", "value", "event_id", "seen").select("event_id", "seen")


@query("""
WITH base AS (SELECT c_custkey FROM customer), o AS (SELECT o_custkey, count(*) AS n_orders, min(CAST(o_orderdate AS DATE)) AS first_date, bool_or(o_orderstatus = 'F') AS any_final FROM orders GROUP BY 1),
l AS (SELECT o_custkey, max(l_quantity) AS most FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, CAST(first_date AS VARCHAR) AS first_date, any_final, most FROM base LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey
""")
def cte_star(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    o = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.min("o_orderdate").cast("date").cast("string").alias("first_date"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_final"))
    most = orders.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("l_quantity").alias("most"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").join(most, "c_custkey", "left").fillna(0, ["n_orders"])


@query("SELECT c_custkey, 'patient_' || lpad(CAST(row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) AS VARCHAR), 6, '0') AS cohort_id FROM customer")
def cohort_ids(spark: SparkSession, d: str) -> DataFrame:
    return cohort.surrogate_ids(table(spark, d, "customer"), "c_custkey")


@query("""
WITH known AS (SELECT c_custkey, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) AS number FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM known UNION ALL SELECT c_custkey, (SELECT max(number) FROM known) + row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_custkey % 2 <> 0
""")
def manifest_extend(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "customer").select("c_custkey")
    empty = spark.createDataFrame([], "c_custkey long, number long")
    known = cohort.extended_manifest(empty, ids.filter("c_custkey % 2 = 0"), "c_custkey")
    return cohort.extended_manifest(known, ids, "c_custkey")


@query("SELECT o_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_row_per_key(spark: SparkSession, d: str) -> DataFrame:
    first = cohort.first_per_key(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey"))
    return first.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))


@query("""
SELECT 'union' AS op, count(*) AS n_rows FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect_all', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'except_all', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    cn, sn = c.select("c_nationkey"), s.select("s_nationkey")
    results = {
        "union": cn.union(sn).distinct(), "union_all": cn.union(sn), "intersect": cn.intersect(sn), "intersect_all": cn.intersectAll(sn),
        "except": c.select("c_custkey").subtract(s.select("s_suppkey")), "except_all": cn.exceptAll(sn),
    }
    return cohort.aligned(*(df.agg(F.lit(name).alias("op"), F.count("*").alias("n_rows")) for name, df in results.items()))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def union_align(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return tables.append_aligned(a, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query("SELECT c_custkey AS record_id, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def scan_filter_project(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").withColumnsRenamed({"c_name": "patient_name", "c_nationkey": "home_address"})
    return cohort.without_pii(cohort.with_record_id(customers, ["person", "c_custkey"])).filter("c_acctbal > 0 AND c_mktsegment = 'BUILDING'")


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'IV' WHEN o_orderpriority LIKE '3%' THEN 'III' ELSE 'I-II' END AS stage,
       regexp_extract(o_orderpriority, '^(\\d)', 1) AS digit
FROM orders WHERE o_orderstatus = 'F'
""")
def stage_case(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    stage = F.when(p.like("1%") | p.like("2%"), "IV").when(p.like("3%"), "III").otherwise("I-II")
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", stage.alias("stage"), F.regexp_extract(p, r"^(\d)", 1).alias("digit"))


@query("SELECT CAST(count(*) AS INTEGER) AS n_rows, max(o_orderkey) AS last_key, (SELECT count(*) FROM orders) > 500 AS over_limit FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500)")
def row_cap(spark: SparkSession, d: str) -> DataFrame:
    # One row more than the cap tells whether there are more; the limit is pushed into the top-n.
    head = table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(501)
    place = head.withColumn("n", F.row_number().over(Window.orderBy("o_orderkey")))
    return place.agg(F.count(F.when(F.col("n") <= 500, 1)).cast("int").alias("n_rows"), F.max(F.when(F.col("n") <= 500, F.col("o_orderkey"))).alias("last_key"), (F.count("*") > 500).alias("over_limit"))


@query("""
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY d NULLS LAST, o_orderkey) AS INTEGER) AS place
FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END AS d FROM orders)
""")
def null_order_sort(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").withColumn("d", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("date")))
    return known.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.asc_nulls_last("d"), "o_orderkey")).alias("place"))


@query("""
SELECT doc_id, (CASE WHEN text LIKE '%@%' THEN 2 ELSE 0 END) + (CASE WHEN text LIKE '%http%' THEN 2 ELSE 0 END) + (CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END) AS score
FROM documents ORDER BY score DESC, doc_id LIMIT 50
""")
def score_topk(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = points(t.contains("@"), 2) + points(t.contains("http"), 2) + points(F.col("n_chars") > 5000, 1)
    return table(spark, d, "documents").select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, 0.0::DOUBLE AS null_fraction, 5 AS n_columns, 'usable' AS verdict FROM documents")
def file_verdict(spark: SparkSession, d: str) -> DataFrame:
    return tables.inspected(table(spark, d, "documents")).withColumn("null_fraction", F.round("null_fraction", 6))


@query("""
SELECT l_orderkey, rpad(substr(CAST(l_quantity AS VARCHAR), 1, 6), 6, ' ') || rpad(substr(l_returnflag, 1, 3), 3, ' ') || rpad(substr(l_linestatus || 'xyz', 1, 2), 2, ' ') AS record
FROM (SELECT l_orderkey, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1
""")
def fixed_width(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    first = cohort.first_per_key(table(spark, d, "lineitem"), ["l_orderkey"], *order).select("l_orderkey", F.col("l_quantity").cast("long").cast("string").alias("a"), F.col("l_returnflag").alias("b"), F.concat("l_linestatus", F.lit("xyz")).alias("c"))
    items = first.select("l_orderkey", F.posexplode(F.array("a", "b", "c")).alias("number", "value"))
    return tables.fixed_width(items, "l_orderkey", "number", "value", [(0, 6), (1, 3), (2, 2)])


@query("""
SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS "Final [1]", max(o_totalprice) FILTER (o_orderstatus = 'O') AS "Open [2]"
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1 AND o_orderstatus IN ('F', 'O') GROUP BY 1
""")
def registry_pivot(spark: SparkSession, d: str) -> DataFrame:
    number = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
    first = cohort.first_per_key(table(spark, d, "orders").withColumn("number", number).filter("number is not null"), ["o_custkey", "number"], F.col("o_orderkey"))
    return tables.registry_table(first, "o_custkey", "number", "o_totalprice", {1: "Final", 2: "Open"})


@query("""
SELECT p_partkey, CASE WHEN length(c) > 3 THEN substr(c, 1, 3) || '.' || substr(c, 4) ELSE c END AS code,
       CASE WHEN c LIKE 'C%' OR regexp_matches(c, '^D[0-4]') THEN 'neoplasm' WHEN regexp_matches(c, '^D[5-8]') THEN 'blood' WHEN c LIKE 'E%' THEN 'endocrine' WHEN c LIKE 'I%' THEN 'circulatory'
            WHEN c LIKE 'J%' THEN 'respiratory' WHEN c LIKE 'K%' THEN 'digestive' WHEN c LIKE 'N%' THEN 'genitourinary' WHEN c LIKE 'R%' THEN 'symptom' WHEN c LIKE 'T%' THEN 'injury' WHEN c LIKE 'Z%' THEN 'encounter' ELSE 'other' END AS chapter
FROM (SELECT p_partkey, substr('CDEIJKNRTZA', CAST(p_partkey % 11 AS INTEGER) + 1, 1) || lpad(CAST(p_size AS VARCHAR), 2, '0') || CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 10 AS VARCHAR) ELSE '' END AS c FROM part)
""")
def code_bucket(spark: SparkSession, d: str) -> DataFrame:
    letter = F.substr(F.lit("CDEIJKNRTZA"), (F.col("p_partkey") % 11).cast("int") + 1, F.lit(1))
    tail = F.when(F.col("p_partkey") % 2 == 0, (F.col("p_partkey") % 10).cast("string")).otherwise("")
    lines = table(spark, d, "part").select("p_partkey", F.concat(letter, F.lpad(F.col("p_size").cast("string"), 2, "0"), tail).alias("c"))
    return lines.select("p_partkey", codes.dotted(F.col("c")).alias("code"), codes.chapter(F.col("c")).alias("chapter"))


@query("""
WITH v AS (SELECT p_brand AS code, min(p_type) AS description FROM part GROUP BY 1),
x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN lower(p_brand) WHEN 2 THEN upper((SELECT description FROM v WHERE v.code = p_brand)) ELSE 'nothing' END AS raw FROM part),
d AS (SELECT lower(description) AS k, min(code) AS code FROM v GROUP BY 1)
SELECT p_partkey, coalesce(a.code, b.code, d.code) AS resolved_code, CASE WHEN a.code IS NOT NULL THEN 1.0 WHEN b.code IS NOT NULL THEN 0.95 WHEN d.code IS NOT NULL THEN 0.9 ELSE 0.0 END::DOUBLE AS resolution_confidence
FROM x LEFT JOIN v a ON a.code = raw LEFT JOIN v b ON lower(b.code) = lower(raw) LEFT JOIN d ON d.k = lower(raw)
""")
def code_resolve(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    vocabulary = part.groupBy(F.col("p_brand").alias("code")).agg(F.min("p_type").alias("description"))
    kind = F.col("p_partkey") % 4
    raw = F.when(kind == 0, F.col("code")).when(kind == 1, F.lower("code")).when(kind == 2, F.upper("description")).otherwise("nothing")
    asked = part.select("p_partkey", F.col("p_brand").alias("code")).join(vocabulary, "code").select("p_partkey", raw.alias("raw"))
    return codes.resolved(asked, vocabulary, "raw").select("p_partkey", "resolved_code", "resolution_confidence")


@query("""
SELECT CASE WHEN l_shipdate < o_orderdate THEN 'before' ELSE 'after' END AS edit, count(*) AS n_rows,
       count(*) FILTER (regexp_matches(c, '^C\\d{2}(\\.?\\d)?$')) AS valid_sites, count(*) FILTER (substr(c, 1, 3) IN ('C61', 'C62', 'C63')) AS male_sites
FROM (SELECT l_shipdate, o_orderdate, 'C' || CAST(l_quantity AS BIGINT) + 20 AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1
""")
def cross_edit(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    site = F.concat(F.lit("C"), (F.col("l_quantity").cast("long") + 20).cast("string"))
    flagged = joined.select(F.when(F.col("l_shipdate") < F.col("o_orderdate"), "before").otherwise("after").alias("edit"), codes.site_valid(site).alias("ok"), codes.sex_edit(site, F.lit("2")).alias("sex"))
    return flagged.groupBy("edit").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("ok"), 1)).alias("valid_sites"), F.count("sex").alias("male_sites"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 2 = 0 THEN '__file__' WHEN c_custkey % 7 = 0 THEN 'name:' || c_name WHEN c_custkey % 5 = 0 THEN 'mrn:M' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS identity,
       CAST(('0x' || substr(sha256('s||' || c_custkey || '||pool'), 1, 16))::UHUGEINT % 8 AS INTEGER) AS pool
FROM customer
""")
def identity_key(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        "c_custkey", F.when((k % 7 != 0) & (k % 5 != 0), k.cast("string")).alias("pid"), F.when((k % 7 != 0) & (k % 5 == 0), F.concat(F.lit("M"), k.cast("string"))).otherwise(F.lit(" nan ")).alias("mrn"),
        F.when(k % 2 != 0, F.col("c_name")).alias("name"),
    )
    identity = deid.identity_key(F.col("pid"), F.col("mrn"), F.col("name"))
    return rows.select("c_custkey", identity.alias("identity"), values.stable_index(8, F.lit("s"), k.cast("string"), F.lit("pool")).alias("pool"))
