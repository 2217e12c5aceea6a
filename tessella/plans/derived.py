"""Queries over derived variables, the privacy gate's masks, and column classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalogue import query, table
from tessella.operators import cohort, deid, derive, models_fit, notes
from tessella.plans import gate
from tessella.plans.dialect import translated


@query("""
SELECT seg, nation, CASE WHEN k < 12 THEN '<12' ELSE CAST(k AS VARCHAR) END AS k, CASE WHEN k >= 12 THEN top END AS top
FROM (SELECT c_mktsegment AS seg, c_nationkey AS nation, count(*) AS k, max(c_acctbal) AS top FROM customer GROUP BY 1, 2)
""")
def gated_unaliased_count(spark: SparkSession, d: str) -> DataFrame:
    """A count under a name that doesn't tell; beside a small one, no other aggregate is shown."""
    table(spark, d, "customer").createOrReplaceTempView("gate_counted")
    asked = "SELECT c_mktsegment AS seg, c_nationkey AS nation, count(*) AS k, max(c_acctbal) AS top FROM gate_counted GROUP BY c_mktsegment, c_nationkey"
    return gate.answer(spark, asked, least=12).data


@query("""
SELECT seg, nation, top FROM (SELECT c_mktsegment AS seg, c_nationkey AS nation, count(*) AS k, max(c_acctbal) AS top FROM customer GROUP BY 1, 2) WHERE k >= 12
""")
def gated_hidden_count(spark: SparkSession, d: str) -> DataFrame:
    """Without any count in the list, groups are judged by a hidden one."""
    table(spark, d, "customer").createOrReplaceTempView("gate_uncounted")
    return gate.answer(spark, "SELECT c_mktsegment AS seg, c_nationkey AS nation, max(c_acctbal) AS top FROM gate_uncounted GROUP BY c_mktsegment, c_nationkey", least=12).data


@query("""
SELECT seg, nation, CASE WHEN n < 12 THEN '<12' ELSE CAST(n AS VARCHAR) END AS n, CASE WHEN people >= 12 THEN top END AS top
FROM (SELECT c_mktsegment AS seg, c_nationkey AS nation, count(*) AS n, max(c_acctbal) AS top, count(DISTINCT c_custkey) AS people FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
""")
def gated_people_of_a_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders multiply the rows of a customer, not the people: groups are judged by the customers behind them."""
    table(spark, d, "customer").createOrReplaceTempView("gate_people")
    table(spark, d, "orders").createOrReplaceTempView("gate_orders")
    asked = "SELECT c_mktsegment AS seg, c_nationkey AS nation, count(*) AS n, max(c_acctbal) AS top FROM gate_people JOIN gate_orders ON o_custkey = c_custkey GROUP BY c_mktsegment, c_nationkey"
    return gate.answer(spark, asked, least=12, protected=("c_custkey",)).data


ASOF = """
SELECT p.event_id AS event_id, v.event_id AS seen, v.value AS value, e.event_id AS error FROM
(SELECT p.event_id, p.user_id, p.ts, v.event_id AS seen FROM (SELECT * FROM {events} WHERE event_type = 'purchase') AS p
 ASOF LEFT JOIN (SELECT * FROM {events} WHERE event_type = 'view') AS v ON p.user_id = v.user_id AND p.ts > v.ts) AS p
ASOF LEFT JOIN (SELECT * FROM {events} WHERE event_type = 'error') AS e ON p.user_id = e.user_id AND p.ts <= e.ts
LEFT JOIN {events} AS v ON v.event_id = p.seen
"""


@query(ASOF.format(events="events"))
def asof_statement(spark: SparkSession, d: str) -> DataFrame:
    """The same statement in either dialect: a purchase with the view before it and the error after it."""
    table(spark, d, "events").createOrReplaceTempView("asof_events")
    return spark.sql(translated(ASOF.format(events="asof_events")))


@query("""
SELECT day, CASE WHEN n < 12 THEN '<12' ELSE CAST(n AS VARCHAR) END AS n, CASE WHEN people >= 12 THEN top END AS top
FROM (SELECT CAST(p.ts AS DATE) AS day, count(*) AS n, max(v.value) AS top, count(DISTINCT p.user_id) AS people
      FROM (SELECT * FROM events WHERE event_type = 'purchase') AS p ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') AS v ON p.user_id = v.user_id AND p.ts >= v.ts GROUP BY 1)
""")
def gated_asof(spark: SparkSession, d: str) -> DataFrame:
    """ASOF JOIN behind the gate: the users behind a day are counted through the stream that the join is made of."""
    table(spark, d, "events").createOrReplaceTempView("gate_events")
    sides = "(SELECT * FROM gate_events WHERE event_type = 'purchase') AS p ASOF JOIN (SELECT * FROM gate_events WHERE event_type = 'view') AS v"
    asked = f"SELECT CAST(p.ts AS DATE) AS day, count(*) AS n, max(v.value) AS top FROM {sides} ON p.user_id = v.user_id AND p.ts >= v.ts GROUP BY CAST(p.ts AS DATE)"
    return gate.answer(spark, asked, least=12, protected=("user_id",)).data


@query("""
SELECT seg, month, CASE WHEN n < 40 THEN '<40' ELSE CAST(n AS VARCHAR) END AS n, CASE WHEN people >= 40 THEN high END AS high
FROM (SELECT seg, month, count(*) AS n, max(most) AS high, max(people) AS people
      FROM (SELECT c_mktsegment AS seg, month(o_orderdate) AS month, c_nationkey, count(DISTINCT c_custkey) AS people, max(o_totalprice) AS most FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3) GROUP BY 1, 2)
""")
def gated_people_of_groups(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate over groups counts as many people as the largest of its groups, at least."""
    table(spark, d, "customer").createOrReplaceTempView("gate_people")
    table(spark, d, "orders").createOrReplaceTempView("gate_orders")
    inner = "SELECT c_mktsegment AS seg, month(o_orderdate) AS month, c_nationkey, max(o_totalprice) AS most FROM gate_people JOIN gate_orders ON o_custkey = c_custkey GROUP BY c_mktsegment, month(o_orderdate), c_nationkey"
    asked = f"SELECT seg, month, count(*) AS n, max(most) AS high FROM ({inner}) GROUP BY seg, month"
    return gate.answer(spark, asked, least=40, protected=("c_custkey",)).data


@query("""
SELECT * FROM (VALUES ('case_id', 'patient_id'), ('last_nm', 'name'), ('fname', 'name'), ('mobile', 'drop'), ('account_no', 'drop'), ('patient_state', 'drop'), ('zipcode', 'drop'), ('insurance_id', 'drop'),
  ('policy_number', 'drop'), ('patient_dob', 'birth_date'), ('remarks', 'text'), ('disease_state', 'keep'), ('drug_name', 'keep'), ('seen', 'date'), ('visit_age', 'age'), ('lang', 'keep')) AS t(column_name, class)
""")
def phi_columns(spark: SparkSession, d: str) -> DataFrame:
    """Names decide where they tell; free text and dates are found by the values of all rows."""
    docs = table(spark, d, "documents")
    named = ("last_nm", "fname", "mobile", "account_no", "patient_state", "zipcode", "insurance_id", "policy_number", "patient_dob", "disease_state", "drug_name", "visit_age")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("doc_id", F.lit(900)).cast("int")), "yyyy-MM-dd")
    wide = docs.select(F.col("doc_id").alias("case_id"), *(F.col("source").alias(c) for c in named), F.col("text").alias("remarks"), day.alias("seen"), "lang")
    return spark.createDataFrame(sorted(deid.classified(wide).items()), "column_name string, class string")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN round(p_retailprice / ((p_size - 25) * (p_size - 25)), 6) END AS bmi FROM part")
def body_mass(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select("p_partkey", F.round(derive.body_mass_index(F.col("p_retailprice"), F.col("p_size") - 25), 6).alias("bmi"))


@query("""
SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS latest,
       arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (o_orderdate <= TIMESTAMP '1995-06-30') AS at_event
FROM orders GROUP BY 1
""")
def ecog_selection(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    until = F.col("o_orderdate") <= F.lit("1995-06-30").cast("timestamp_ntz")
    latest = derive.selected(orders, ["o_custkey"], "o_orderpriority", "o_orderdate", "o_orderkey", name="latest")
    return latest.join(derive.selected(orders, ["o_custkey"], "o_orderpriority", "o_orderdate", "o_orderkey", until=until, name="at_event"), "o_custkey")


@query("""
WITH p AS (SELECT user_id, event_type, max(value >= 200) AS hit FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2)
SELECT user_id, CASE WHEN bool_or(hit) THEN false WHEN count(*) = 3 THEN true END AS triple_negative FROM p GROUP BY 1
""")
def biomarker_composite(spark: SparkSession, d: str) -> DataFrame:
    tests = ["click", "view", "error"]
    events = table(spark, d, "events").filter(F.col("event_type").isin(tests))
    return derive.all_negative(events, ["user_id"], "event_type", derive.reaches(F.col("value"), 200), tests, "triple_negative")


@query("""
SELECT o_custkey, bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS any_urgent, bool_or(o_orderpriority = '5-LOW') AS any_low FROM orders GROUP BY 1
""")
def treatment_flags(spark: SparkSession, d: str) -> DataFrame:
    return derive.class_flags(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", {"any_urgent": ["1-URGENT", "2-HIGH"], "any_low": ["5-LOW"]})


@query("""
SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS most_recent, count(o_orderstatus) AS n_values,
       string_agg(DISTINCT o_orderstatus, '; ' ORDER BY o_orderstatus) AS distinct_values,
       CASE max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END) WHEN 1 THEN 'F' WHEN 2 THEN 'O' WHEN 3 THEN 'P' END AS worst,
       bool_or(o_totalprice > 300000) AS any_positive
FROM orders GROUP BY 1
""")
def multi_row_reducers(spark: SparkSession, d: str) -> DataFrame:
    return derive.reduced(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["o_orderdate", "o_orderkey"], {"F": 1, "O": 2, "P": 3}, F.col("o_totalprice") > 300000)


@query("""
WITH j AS (SELECT o_orderkey, l_tax, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) - 60 AS days FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 4) l ON o_orderkey = l_orderkey),
s AS (
  SELECT 'o_orderkey' AS column_name, 1 - count(o_orderkey) / count(*) AS m, 0 AS n_negative FROM j
  UNION ALL SELECT 'l_tax', 1 - count(l_tax) / count(*), 0 FROM j
  UNION ALL SELECT 'days', 1 - count(days) / count(*), count(*) FILTER (days < 0) FROM j
)
SELECT column_name, round(m, 9) AS missing_share, m > 0.3 AS often_missing, CAST(n_negative AS BIGINT) AS n_negative FROM s
""")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_linenumber = 4")
    joined = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")) - 60
    flags = derive.quality_flags(joined.select("o_orderkey", "l_tax", days.alias("days")), ["o_orderkey", "l_tax", "days"], ["days"])
    return flags.withColumn("missing_share", F.round("missing_share", 9))


@query("""
SELECT * FROM (VALUES ('c_custkey', 'first'), ('c_name', 'first'), ('key', 'shared'), ('name', 'second')) AS t(column_name, standing)
JOIN (SELECT 'c_custkey' AS column_name, count(c_custkey) AS n_values FROM customer UNION ALL SELECT 'c_name', count(c_name) FROM customer
      UNION ALL SELECT 'key', (SELECT count(c_nationkey) FROM customer) + count(n_nationkey) FROM nation UNION ALL SELECT 'name', count(n_name) FROM nation) USING (column_name)
""")
def column_sets(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("KEY"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    """Where each column stands, whatever its case, and the values that it holds in both tables."""
    held = [cohort.nonnull_counts(t.toDF(*(c.lower() for c in t.columns))) for t in (customers, nations)]
    counts = held[0].unionByName(held[1]).groupBy("column_name").agg(F.sum("n_values").alias("n_values"))
    return derive.column_sets(customers, nations).join(counts, "column_name")


@query("""
SELECT l_returnflag, round(skewness(l_quantity * l_quantity), 6) AS skew, round(kurtosis(l_quantity * l_quantity), 6) AS kurt, round(kurtosis_pop(l_quantity), 6) AS kurt_pop FROM lineitem GROUP BY 1
""")
def sample_moments(spark: SparkSession, d: str) -> DataFrame:
    """Skewness and kurtosis as the other dialect defines them, corrected for the sample."""
    table(spark, d, "lineitem").createOrReplaceTempView("dialect_lines")
    return spark.sql(translated(
        "SELECT l_returnflag, round(skewness(l_quantity * l_quantity), 6) AS skew, round(kurtosis(l_quantity * l_quantity), 6) AS kurt, round(kurtosis_pop(l_quantity), 6) AS kurt_pop FROM dialect_lines GROUP BY 1"
    ))


@query("""
WITH n AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1, 2),
r AS (SELECT a, sum(n) AS ra FROM n GROUP BY 1), c AS (SELECT b, sum(n) AS cb FROM n GROUP BY 1), t AS (SELECT sum(n) AS total FROM n)
SELECT 'chi-square' AS method, round(total * (sum(n * n / (ra * cb)) - 1), 6) AS statistic, 1 AS degrees FROM n JOIN r USING (a) JOIN c USING (b), t GROUP BY total
""")
def association(spark: SparkSession, d: str) -> DataFrame:
    """Chi-square where no cell of a two-by-two table is under 5; else it would be Fisher's exact test."""
    some = table(spark, d, "orders").filter((F.col("o_orderstatus") != "P") & F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    found = models_fit.association(some, "o_orderstatus", "o_orderpriority")
    return spark.createDataFrame([(found["method"], round(found["statistic"], 6), int(found["degrees"]))], "method string, statistic double, degrees int")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) AS BIGINT) AS place FROM orders")
def global_numbers(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("as_text"))
    return cohort.numbered(ids, "as_text", name="place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("""
WITH s AS (SELECT o_custkey, lower(trim(o_orderstatus)) AS said, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, CAST(sum(n) AS BIGINT) AS n_answers, count(*) AS n_different, string_agg(said, '; ' ORDER BY said) AS answers FROM s GROUP BY 1 HAVING count(*) > 1
""")
def answer_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return notes.contradictions(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus")
