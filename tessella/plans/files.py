"""Queries over readers and writers by round trips, edits, and streams by a bounded replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessella.catalogue import query, table
from tessella.functions import text
from tessella.operators import codes, deid, derive, notes
from tessella.session import shared_path
from tessella.sources import tables
from tessella.streaming import feeds


def _written(df: DataFrame, name: str) -> str:
    path = shared_path(df.sparkSession, name)
    tables.write_table(df, path) if name.endswith(("csv", "tsv")) else df.write.text(path)
    return path


@query("SELECT 'K' || p_partkey AS code, p_name AS description, CASE WHEN p_size > 5 THEN p_brand END AS category FROM part WHERE p_size > 2")
def vocabulary_scan(spark: SparkSession, d: str) -> DataFrame:
    """Codes and descriptions lose their blanks, rows without a description go."""
    part = table(spark, d, "part").select(
        F.concat(F.lit(" K"), "p_partkey").alias("code"), F.when(F.col("p_size") > 2, F.concat(F.lit("  "), "p_name", F.lit(" "))).otherwise("  ").alias("description"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("category"),
    )
    return tables.read_vocabulary(spark, _written(part, "vocabulary.csv"))


@query("SELECT 'C' || p_partkey AS code, p_name AS description FROM part")
def code_line_scan(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "part").select(F.concat(F.lit("C"), "p_partkey", F.lit("    "), "p_name", F.lit("  ")).alias("value"))
    return tables.code_lines(spark.read.text(_written(lines, "codes.txt")))


@query("""
SELECT 'Which is ' || p_name || '?' || p_partkey AS question, CASE WHEN p_size % 2 = 0 THEN p_brand || '|' || p_type ELSE '' END AS options FROM part WHERE p_partkey % 3 > 0
""")
def question_scan(spark: SparkSession, d: str) -> DataFrame:
    """Options in a trailing bracket; comments and blank lines are none."""
    asked = F.concat(F.lit("Which is "), "p_name", F.lit("?"), "p_partkey")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("# "), asked)).when(F.col("p_size") % 2 == 0, F.concat(asked, F.lit(" ("), "p_brand", F.lit("; "), "p_type", F.lit(")"))).otherwise(asked)
    read = tables.read_questions(spark, _written(table(spark, d, "part").select(line.alias("value")), "questions.txt"))
    return read.select("question", F.array_join("options", "|").alias("options"))


@query("SELECT p_name || ' ' || p_partkey AS generic, p_brand || ';' || p_type AS alternatives FROM part")
def drug_map_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.concat(F.lit(" "), "p_name", F.lit(" "), "p_partkey").alias("generic"), F.concat("p_brand", F.lit(" | |"), "p_type").alias("alternatives"))
    return tables.read_drug_map(spark, _written(rows, "drugs.csv")).select("generic", F.array_join("alternatives", ";").alias("alternatives"))


@query("SELECT CAST(p_partkey AS INTEGER) AS item_number, p_name, p_size > 25 AS active FROM part WHERE p_partkey % 5 > 0")
def dictionary_scan(spark: SparkSession, d: str) -> DataFrame:
    """Items whose number is none go, retired ones are told."""
    number = F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey").cast("string")).otherwise(F.concat("p_partkey", F.lit("a")))
    rows = table(spark, d, "part").select(number.alias("item_number"), "p_name", F.when(F.col("p_size") <= 25, F.col("p_size") + 1990).alias("year_retired"))
    return tables.read_dictionary(spark, _written(rows, "dictionary.csv")).select("item_number", "p_name", "active")


@query("SELECT 'case ' || c_custkey AS blurb, CASE WHEN c_nationkey > 9 THEN c_nationkey ELSE 5 END::INTEGER AS n_patients, CAST(NULL AS VARCHAR) AS label FROM customer")
def scenario_scan(spark: SparkSession, d: str) -> DataFrame:
    """A missing number of patients is five, a missing column null."""
    rows = table(spark, d, "customer").select(F.concat(F.lit("case "), "c_custkey").alias("blurb"), F.when(F.col("c_nationkey") > 9, F.col("c_nationkey")).alias("n_patients"))
    return tables.read_scenarios(spark, _written(rows, "scenarios.csv"))


@query("""
SELECT 'approved' AS table_name, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_patients FROM orders
UNION ALL SELECT 'held back', count(*) FILTER (false), NULL FROM customer
""")
def database_sink(spark: SparkSession, d: str) -> DataFrame:
    """Only approved tables are saved; the catalogue doesn't show ids."""
    folder = shared_path(spark, "database")
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "record_id").withColumnRenamed("o_orderkey", "sink_order")
    tables.save_database({"sink_approved": orders, "sink_held": table(spark, d, "customer")}, folder, {"sink_approved"})
    shown = [(t, c) for t, c, _ in tables.catalog(spark) if t.startswith("sink_")]
    saved = spark.read.parquet(f"{folder}/sink_approved").agg(F.lit("approved").alias("table_name"), F.count("*").alias("n_rows"), F.countDistinct("record_id").alias("n_patients"))
    held = spark.createDataFrame([("held back", sum(t == "sink_held" or c == "record_id" for t, c in shown), None)], "table_name string, n_rows long, n_patients long")
    return saved.unionByName(held)


@query("""
SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) + 60) AS n_before FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
""")
def treatment_dates(spark: SparkSession, d: str) -> DataFrame:
    """Treatments before the diagnosis, in two formats of a registry."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    before = codes.treatment_edit(F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 60), "yyyyMMdd"), F.date_format("l_shipdate", "MM/dd/yyyy"))
    return lines.groupBy("l_returnflag").agg(F.count("*").alias("n_rows"), F.count(F.when(before, 1)).alias("n_before"))


@query("""
SELECT o_orderkey, 'Is it ' || o_orderpriority || '?' AS question FROM orders
""")
def answers_to_questions(spark: SparkSession, d: str) -> DataFrame:
    """Keys that a model gave back in another case, or with more around them, beside the question that each means."""
    orders = table(spark, d, "orders")
    asked = F.concat(F.lit("Is it "), "o_orderpriority", F.lit("?"))
    key = F.when(F.col("o_orderkey") % 3 == 0, asked).when(F.col("o_orderkey") % 3 == 1, F.upper(asked)).otherwise(F.concat(F.lit("q: "), asked, F.lit(" yes")))
    return notes.answers_by_question(orders.select("o_orderkey", key.alias("key")), orders.select(asked.alias("question")).distinct()).select("o_orderkey", "question")


def _replayed(spark: SparkSession, df: DataFrame, of) -> DataFrame:
    """What a stream over ``df``, written in some files, tells in its last update of each key; every micro-batch is written."""
    folder, out = shared_path(spark, "feed"), shared_path(spark, "updates")
    df.repartition(4).write.parquet(folder)
    stream = of(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(folder))
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", shared_path(spark, "checkpoint")).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(out)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def stream_last_record(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each user, kept as state over micro-batches of files in any order."""
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    updates = _replayed(spark, events, lambda s: feeds.latest(s, ["user_id"], "ts", "event_id"))
    return updates.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), "batch").alias("last")).select("user_id", "last.*")


@query("SELECT user_id, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_running_state(spark: SparkSession, d: str) -> DataFrame:
    """Records folded into a state of each user."""
    events = table(spark, d, "events").select("user_id", "ts", "value")
    updates = _replayed(spark, events, lambda s: feeds.running_state(s, "user_id", "ts", "value"))
    return updates.groupBy("user_id").agg(F.max("n_events").alias("n_events"), F.round(F.max_by("total", "n_events"), 4).alias("total"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'GSE' || (10000 + p_partkey) ELSE '' END AS gse, CASE p_partkey % 4 WHEN 1 THEN p_partkey || ';' || (p_partkey + 1) ELSE '' END AS zenodo,
       CASE p_partkey % 4 WHEN 2 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS figshare, CASE WHEN p_partkey % 8 = 3 THEN '10.5061/dryad.x' || p_partkey ELSE '' END AS dryad, p_partkey % 8 <> 7 AS has_data
FROM part
""")
def repository_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of four data repositories, in either form, each once; a paper without any shows no data."""
    k = F.col("p_partkey").cast("string")
    said = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("GSE"), (F.col("p_partkey") + 10_000).cast("string"), F.lit(", again GSE"), (F.col("p_partkey") + 10_000).cast("string")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("doi 10.5281/zenodo."), (F.col("p_partkey") + 1).cast("string"), F.lit(" and https://zenodo.org/records/"), k))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("figshare.com/articles/dataset/"), k, F.lit(" or 10.6084/m9.figshare."), k))
        .when(F.col("p_partkey") % 8 == 3, F.concat(F.lit("https://doi.org/10.5061/dryad.x"), k, F.lit("."))).otherwise("data on request")
    )
    ids = table(spark, d, "part").select("p_partkey", text.repository_ids(said).alias("ids"))
    return ids.select("p_partkey", *(F.array_join(F.col("ids")[name], ";").alias(name) for name in text.REPOSITORIES), text.names_data(F.col("ids")).alias("has_data"))


@query("""
SELECT c_custkey, column_name, left(v, 200) AS preview FROM (
  SELECT c_custkey, 'note' AS column_name, 'mail c' || c_custkey || '@example.org ' || repeat('x', 250) AS v FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 'remark', 'call 555-123-4567, Mrs. Smith' FROM customer WHERE c_custkey % 5 = 1)
""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    note = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("mail c"), "c_custkey", F.lit("@example.org "), F.repeat(F.lit("x"), F.lit(250)))).otherwise("nothing to see")
    remark = F.when(F.col("c_custkey") % 5 == 1, "call 555-123-4567, Mrs. Smith").when(F.col("c_custkey") % 5 == 2, "stage 3 of 2020")
    return deid.review_queue(table(spark, d, "customer").select("c_custkey", note.alias("note"), remark.alias("remark")), "c_custkey", ["note", "remark"])


@query("""
WITH j AS (SELECT l_quantity, CASE WHEN l_discount > 0 THEN l_discount END AS l_discount, CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS flag FROM lineitem),
r AS (
  SELECT 'l_quantity' AS column_name, count(*) - count(l_quantity) AS n_missing, count(*) AS n, min(l_quantity)::DOUBLE AS least, quantile_cont(l_quantity::DOUBLE, 0.25) AS q1, quantile_cont(l_quantity::DOUBLE, 0.5) AS median, quantile_cont(l_quantity::DOUBLE, 0.75) AS q3, max(l_quantity)::DOUBLE AS largest FROM j
  UNION ALL SELECT 'l_discount', count(*) - count(l_discount), count(*), min(l_discount), quantile_cont(l_discount::DOUBLE, 0.25), quantile_cont(l_discount::DOUBLE, 0.5), quantile_cont(l_discount::DOUBLE, 0.75), max(l_discount) FROM j
  UNION ALL SELECT 'flag', count(*) - count(flag), count(*), NULL, NULL, NULL, NULL, NULL FROM j)
SELECT column_name, n_missing, round(100.0::DOUBLE * n_missing / n, 6) AS missing_pct, round(least, 6) AS least, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(largest, 6) AS largest FROM r
""")
def column_report(spark: SparkSession, d: str) -> DataFrame:
    """Missing values of every column, quartiles of numbers."""
    lines = table(spark, d, "lineitem").select("l_quantity", F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("flag"))
    got = derive.column_report(lines, ["l_quantity", "l_discount"], ["flag"])
    return got.withColumns({c: F.round(c, 6) for c in ("missing_pct", "least", "q1", "median", "q3", "largest")})


@query("""
WITH j AS (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority, CAST(o_custkey % 50 AS VARCHAR) AS ward FROM orders),
c AS (SELECT 'priority' AS column_name, priority AS value, count(*) AS n FROM j GROUP BY 2 UNION ALL SELECT 'ward', ward, count(*) FROM j GROUP BY 2)
SELECT column_name, value, n, round(100.0::DOUBLE * n / (SELECT count(*) FROM j), 6) AS pct FROM c QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value NULLS FIRST) <= 10
""")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent values of each column, null among them."""
    orders = table(spark, d, "orders").select(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"), (F.col("o_custkey") % 50).alias("ward"))
    return derive.value_counts(orders, ["priority", "ward"]).withColumn("pct", F.round("pct", 6))
