"""Queries over survival by group, fuzzy code search, text automata and recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalogue import query, table
from tessella.operators import codes, expression, graphs, models_fit, rounds, stats, survival
from tessella.plans.dialect import translated
from tessella.session import shared_path

SUBJECTS_SQL = """
s AS (SELECT CAST((CAST(o_orderdate AS DATE) - DATE '1992-01-01') // 30 AS INTEGER) AS t, o_orderstatus = 'F' AS ev, o_orderpriority AS arm,
             CAST((CAST(o_orderdate AS DATE) - DATE '1992-01-01') // 30 - 1 - o_orderkey % 24 AS INTEGER) AS entry FROM orders),
"""
CURVE_SQL = """
m AS (SELECT arm, t, count(*) AS m, count(*) FILTER (ev) AS d FROM s GROUP BY 1, 2),
r AS (SELECT arm, t, d, sum(m) OVER (PARTITION BY arm ORDER BY t DESC) AS n FROM m),
k AS (SELECT arm, t, n, d, min(1 - d / n) OVER w AS lowest, sum(CASE WHEN d < n THEN ln(1 - d / n) END) OVER w AS logs, sum(CASE WHEN d < n THEN d / (n * (n - d)) END) OVER w AS spread
      FROM r WHERE d > 0 WINDOW w AS (PARTITION BY arm ORDER BY t)),
c AS (SELECT arm, t, n, d, spread, logs, CASE WHEN lowest > 0 THEN exp(logs) ELSE 0 END AS s FROM k)
"""


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    months = F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) / 30).cast("int")
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("arm"), months.alias("t"), (F.col("o_orderstatus") == "F").alias("ev"), "o_totalprice")
    return orders.withColumn("entry", (F.col("t") - 1 - F.col("o_orderkey") % 24).cast("int"))


@query(f"""
WITH {SUBJECTS_SQL} {CURVE_SQL}
SELECT arm, t AS time, CAST(n AS BIGINT) AS at_risk, d AS events, round(s, 9) AS survival, round(CASE WHEN s > 0 THEN s * sqrt(spread) ELSE 0 END, 9) AS std_error,
       round(CASE WHEN s > 0 THEN pow(s, exp(-{survival.Z} * sqrt(spread) / logs)) END, 8) AS lower, round(CASE WHEN s > 0 THEN pow(s, exp({survival.Z} * sqrt(spread) / logs)) END, 8) AS upper FROM c
""")
def survival_by_group(spark: SparkSession, d: str) -> DataFrame:
    got = survival.curve(_subjects(spark, d), "t", "ev", "arm")
    return got.withColumns({c: F.round(c, 8 if c in ("lower", "upper") else 9) for c in ("survival", "std_error", "lower", "upper")})


@query(f"""
WITH {SUBJECTS_SQL} {CURVE_SQL}
SELECT g.arm, g.n, g.events, min(t) FILTER (s <= 0.5) AS median, round(coalesce(arg_max(s, t) FILTER (t <= 12), 1), 9) AS at_12, round(coalesce(arg_max(s, t) FILTER (t <= 36), 1), 9) AS at_36, round(coalesce(arg_max(s, t) FILTER (t <= 60), 1), 9) AS at_60
FROM (SELECT arm, count(*) AS n, count(*) FILTER (ev) AS events FROM s GROUP BY 1) g LEFT JOIN c ON c.arm = g.arm GROUP BY 1, 2, 3
""")
def survival_summary(spark: SparkSession, d: str) -> DataFrame:
    """Medians and survival after one, three and five years."""
    got = survival.summary(_subjects(spark, d), "t", "ev", "arm", [12, 36, 60])
    return got.withColumns({c: F.round(c, 9) for c in ("at_12", "at_36", "at_60")})


@query(f"""
WITH {SUBJECTS_SQL}
m AS (SELECT t, arm, count(*) AS m, count(*) FILTER (ev) AS d FROM s GROUP BY 1, 2),
a AS (SELECT t, sum(d) AS d FROM m GROUP BY 1),
g AS (SELECT DISTINCT arm FROM s),
r AS (SELECT a.t, a.d, g.arm, coalesce(m.d, 0) AS own, sum(coalesce(m.m, 0)) OVER (PARTITION BY g.arm ORDER BY a.t DESC) AS n1 FROM a CROSS JOIN g LEFT JOIN m ON m.t = a.t AND m.arm = g.arm),
n AS (SELECT t, sum(n1) AS n FROM r GROUP BY 1)
SELECT arm, CAST(sum(own) AS BIGINT) AS observed, round(sum(r.d * n1 / n), 6) AS expected FROM r JOIN n USING (t) WHERE r.d > 0 GROUP BY 1
""")
def log_rank_groups(spark: SparkSession, d: str) -> DataFrame:
    """Events seen and expected in each group if all had one curve."""
    return survival.log_rank(_subjects(spark, d), "t", "ev", "arm")[0].withColumn("expected", F.round("expected", 6))


@query(f"""
WITH {SUBJECTS_SQL}
m AS (SELECT t, count(*) AS m, count(*) FILTER (ev) AS d, count(*) FILTER (arm < '3') AS m1, count(*) FILTER (ev AND arm < '3') AS d1 FROM s GROUP BY 1),
r AS (SELECT t, d, d1, sum(m) OVER w AS n, sum(m1) OVER w AS n1 FROM m WINDOW w AS (ORDER BY t DESC)),
x AS (SELECT sum(d1 - d * n1 / n) AS apart, sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * (n1 / n) * (1 - n1 / n) ELSE 0 END) AS v FROM r WHERE d > 0)
SELECT round(apart * apart / v, 6) AS statistic, CAST(1 AS INTEGER) AS degrees FROM x
""")
def log_rank_test(spark: SparkSession, d: str) -> DataFrame:
    two = _subjects(spark, d).withColumn("urgent", F.when(F.col("arm") < "3", "yes").otherwise("no"))
    got = survival.log_rank(two, "t", "ev", "urgent")[1]
    return spark.createDataFrame([(round(got["statistic"], 6), got["degrees"])], "statistic double, degrees int")


@query()
def cox_with_entry(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of a Cox regression with delayed entry and Efron's ties; a brute-force likelihood holds it in the tests."""
    rows = _subjects(spark, d).withColumns({"urgent": (F.col("arm") < "3").cast("int"), "price": F.col("o_totalprice") / 100_000})
    got = models_fit.cox(rows, "t", "ev", ["urgent", "price"], entry="entry", efron=True)
    return spark.createDataFrame([(c, b, s) for c, (b, s) in got.items()], "covariate string, coefficient double, std_error double")


def _words(df: DataFrame, least: int) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).filter(F.length("word") >= least).distinct()


@query("""
WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark)
SELECT word, term, round(100 * (1 - levenshtein(word, term) / greatest(length(word), length(term))), 6) AS score FROM d, b
WHERE length(word) >= 7 AND length(term) >= 7 AND 4 * levenshtein(word, term) <= greatest(length(word), length(term))
""")
def fuzzy_words(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the documents beside all words of the benchmark that are spelt like it: all pairs, found by grams."""
    got = codes.alike(_words(table(spark, d, "documents"), 7), _words(table(spark, d, "benchmark"), 7).withColumnRenamed("word", "term"), "word", "term", 75.0)
    return got.withColumn("score", F.round("score", 6))


@query("""
WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)
SELECT word, count(*) AS n_docs FROM k JOIN documents ON contains(lower(text), word) WHERE length(word) >= 6 GROUP BY word
""")
def keyword_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which each keyword stands, as a word or within one."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return codes.containing(docs, _words(table(spark, d, "benchmark"), 6), "text", "word").groupBy("word").agg(F.count("*").alias("n_docs"))


class Echo:
    """A stand-in for a model: what the prompt says after its first line."""

    def generate(self, prompt: str) -> str:
        return prompt.split("\n", 1)[1]


@query("""
WITH c AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS step, o_orderpriority AS v, CAST(o_orderkey % 97 AS DOUBLE) / 100 AS sure FROM orders),
k AS (SELECT *, sure >= 0.9 AS locks FROM c)
SELECT o_custkey, CAST(max(step) // 5 + 1 AS INTEGER) AS rounds, 'priority' AS field,
       CASE WHEN bool_or(locks) THEN arg_min(v, step) FILTER (locks) ELSE arg_max(v, (sure, -step)) END AS value,
       CASE WHEN bool_or(locks) THEN arg_min(sure, step) FILTER (locks) ELSE max(sure) END AS confidence,
       CAST(CASE WHEN bool_or(locks) THEN min(step) FILTER (locks) ELSE arg_max(step, (sure, -step)) END AS INTEGER) AS step
FROM k GROUP BY 1
""")
def rounds_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a customer's notes, five a round: a run that stops after its second round, and is taken up again."""
    sure = (F.col("o_orderkey") % 97).cast("double") / 100
    said = F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("value"), sure.alias("confidence")).alias("priority")))
    notes = table(spark, d, "orders").select("o_custkey", "o_orderkey", said.alias("text"))
    folder = shared_path(spark, "rounds")
    rounds.extract(notes, "o_custkey", "o_orderkey", "text", Echo(), folder, most=1)
    return rounds.final_rows(rounds.extract(notes, "o_custkey", "o_orderkey", "text", Echo(), folder), "o_custkey")


QUALIFY = """
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM {orders}
WHERE o_orderstatus <> 'P' QUALIFY place <= 2 AND o_totalprice > avg(o_totalprice) OVER (PARTITION BY o_orderpriority)
"""


@query(QUALIFY.format(orders="orders"))
def qualified_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same statement in either dialect: QUALIFY over a window in the list and one in the condition."""
    table(spark, d, "orders").createOrReplaceTempView("qualify_orders")
    return spark.sql(translated(QUALIFY.format(orders="qualify_orders")))


@query("""
WITH r AS (SELECT p_partkey, p_brand, p_size - 25 AS s, row_number() OVER (ORDER BY p_size - 25 DESC, p_partkey) AS k, count(*) OVER () AS n FROM part),
b AS (SELECT DISTINCT p_brand FROM part),
w AS (SELECT b.p_brand, r.k, CASE WHEN r.p_brand = b.p_brand THEN abs(s)::DOUBLE / sum(CASE WHEN r.p_brand = b.p_brand THEN abs(s) END) OVER v ELSE -1.0::DOUBLE / (n - count(*) FILTER (r.p_brand = b.p_brand) OVER v) END AS step, count(*) FILTER (r.p_brand = b.p_brand) OVER v AS size
      FROM b, r WINDOW v AS (PARTITION BY b.p_brand)),
u AS (SELECT p_brand, size, sum(step) OVER (PARTITION BY p_brand ORDER BY k) AS v FROM w)
SELECT p_brand, size, round(CASE WHEN max(v) >= -min(v) THEN max(v) ELSE min(v) END, 6) AS enrichment FROM u GROUP BY 1, 2
""")
def gene_set_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Brands as gene sets, parts as genes in the order of their size."""
    part = table(spark, d, "part")
    got = expression.enrichment(part.select("p_partkey", (F.col("p_size") - 25).alias("score")), part, "p_partkey", "score", "p_brand")
    return got.withColumn("enrichment", F.round("enrichment", 6))


@query()
def moderated_expression(spark: SparkSession, d: str) -> DataFrame:
    """Parts as genes, suppliers in twelve samples, quantities as counts; plain Python holds it in the tests."""
    lines = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 500).alias("gene"), (F.col("l_suppkey") % 12).alias("sample")).agg(F.sum("l_quantity").alias("count"))
    grid = lines.select("gene").distinct().withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("sample", F.col("sample").cast("long"))
    filled = grid.join(lines, ["gene", "sample"], "left").withColumn("count", F.coalesce("count", F.lit(0.0)))
    return expression.moderated_t(filled, "gene", "sample", "count", F.col("sample") < 6)


QUANTILES = "SELECT l_returnflag, CAST(quantile_disc(l_quantity, 0.25) AS DOUBLE) AS q1, CAST(quantile_disc(round(l_extendedprice, 1), 0.9) AS DOUBLE) AS high FROM {lines} GROUP BY l_returnflag"


@query(QUANTILES.format(lines="lineitem"))
def discrete_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """The same statement in either dialect."""
    table(spark, d, "lineitem").createOrReplaceTempView("quantile_lines")
    return spark.sql(translated(QUANTILES.format(lines="quantile_lines")))


@query("""
WITH r AS (SELECT l_returnflag = 'R' AS g, l_quantity AS v, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS mid FROM lineitem),
u AS (SELECT sum(mid) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2 AS u, count(*) FILTER (g)::DOUBLE AS n1, count(*) FILTER (NOT g)::DOUBLE AS n2, count(*)::DOUBLE AS n FROM r),
t AS (SELECT sum(pow(m, 3) - m) AS ties FROM (SELECT count(*)::DOUBLE AS m FROM lineitem GROUP BY l_quantity))
SELECT round(u, 1) AS u, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
       round(sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM u, t
""")
def rank_test_deviate(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of returned lines against all others, with many ties."""
    got = stats.mann_whitney_z(table(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R")
    return got.select(F.round("u", 1).alias("u"), "n1", "n2", F.round("z", 6).alias("z"))


@query("""
WITH e AS (SELECT c_nationkey AS s, s_nationkey AS d, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
a AS (SELECT s AS u, d AS v, w FROM e UNION ALL SELECT d, s, w FROM e),
p AS (SELECT n.n_regionkey AS c, o.n_regionkey AS d, w FROM a JOIN nation n ON n.n_nationkey = u JOIN nation o ON o.n_nationkey = v),
t AS (SELECT sum(w) AS total FROM p)
SELECT c AS region, round(sum(CASE WHEN c = d THEN w ELSE 0 END) / any_value(total), 9) AS inside, round(sum(w) / any_value(total), 9) AS share,
       round(sum(CASE WHEN c = d THEN w ELSE 0 END) / any_value(total) - pow(sum(w) / any_value(total), 2), 9) AS modularity FROM p, t GROUP BY 1
""")
def trade_between_regions(spark: SparkSession, d: str) -> DataFrame:
    """Nations tied by what their customers buy of their suppliers: how well regions divide that graph."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sold = lines.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    members = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    got = graphs.division(graphs.adjacency(sold, "c_nationkey", "s_nationkey", "n"), members, "n_nationkey", "region")
    return got.select("region", *(F.round(c, 9).alias(c) for c in ("inside", "share", "modularity")))


@query()
def embedding_communities(spark: SparkSession, d: str) -> DataFrame:
    """All embeddings as a graph of ten neighbours each, divided; brute force and planted groups hold it in the tests."""
    near = graphs.neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 10)
    return graphs.communities(graphs.adjacency(near, "src", "dst")).withColumnRenamed("node", "vec_id")
