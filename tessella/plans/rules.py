"""Queries over single rules: reading and writing, renaming, redaction, text, validation and the gate's policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalogue import query, table
from tessella.functions import text, values
from tessella.operators import codes, cohort, deid, derive, notes, survival
from tessella.plans import gate
from tessella.session import shared_path
from tessella.sources import extractions, tables


def _round_trip(spark: SparkSession, df: DataFrame, suffix: str, infer: bool = True) -> DataFrame:
    path = shared_path(spark, f"trip.{suffix}")
    tables.write_table(df, path)
    return tables.read_table(spark, path, infer)


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment || ', \"' || c_nationkey || '\"' AS quoted FROM customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat("c_mktsegment", F.lit(', "'), "c_nationkey", F.lit('"')).alias("quoted")
    read = _round_trip(spark, table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", quoted), "csv")
    return read.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal", "quoted")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, table(spark, d, "supplier").select("s_suppkey", "s_name"), "tsv", infer=False)


@query("SELECT doc_id, text, lang FROM documents")
def note_lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, table(spark, d, "documents").select("doc_id", "text", "lang"), "jsonl").select("doc_id", "text", "lang")


@query("SELECT patient_id, 1 AS round, 'new ' || o_orderstatus AS extraction, 2 AS num_chunks FROM (SELECT DISTINCT 'p' || o_orderkey AS patient_id, o_orderstatus FROM orders)")
def round_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """The last line of a patient and round wins; broken and blank lines are skipped."""
    line = lambda what: F.to_json(F.struct(F.concat(F.lit("p"), "o_orderkey").alias("patient_id"), F.lit(1).alias("round"), F.concat(F.lit(what), "o_orderstatus").alias("extraction"), F.lit(2).alias("num_chunks")))
    lines = table(spark, d, "orders").select(F.concat_ws("\n", line("old "), F.lit("{broken"), F.lit(""), line("new ")).alias("value"))
    path = shared_path(spark, "rounds")
    lines.write.text(path)
    return tables.read_rounds(spark, path)


@query("SELECT c_custkey AS record_id, 'structured' AS source, lower(c_mktsegment) AS segment, CAST(c_nationkey AS DOUBLE) AS nation FROM customer")
def harmonised_projection(spark: SparkSession, d: str) -> DataFrame:
    mappings = [
        {"category": "person", "column": "c_name", "field": "segment", "transform": "uppercase"}, {"category": "person", "column": "c_mktsegment", "field": "segment", "transform": "lowercase"},
        {"category": "person", "column": "c_nationkey", "field": "nation", "transform": "to_numeric"}, {"category": "other", "column": "absent", "field": "x"},
    ]
    made = cohort.harmonised(table(spark, d, "customer").withColumnRenamed("c_custkey", "record_id"), "record_id", mappings)
    return made["person"] if set(made) == {"person"} else spark.createDataFrame([], "record_id long, source string, segment string, nation double")


@query("SELECT c_custkey AS record_id, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def canonical_columns(spark: SparkSession, d: str) -> DataFrame:
    """Renamed, the first id of the list that the table has as record_id, columns with personal data left out."""
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("patient_name"), F.col("c_nationkey").alias("home_phone"), "c_mktsegment", "c_acctbal")
    named = cohort.renamed(customers, {"c_mktsegment": "segment", "c_acctbal": "balance", "absent": "x"})
    return cohort.without_pii(cohort.with_record_id(named, ["patient_id", "c_custkey", "segment"]))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey FROM orders")
def schema_order(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderkey", "o_orderstatus")
    return tables.ordered_columns(orders, ["o_orderkey", "absent", "o_orderstatus", "o_totalprice"])


@query("""
WITH j AS (SELECT o_orderkey, l_tax, CASE WHEN l_orderkey % 700 = 1 THEN l_discount END AS rare FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 6) l ON o_orderkey = l_orderkey)
SELECT * FROM (SELECT 'o_orderkey' AS column_name, count(o_orderkey) AS n FROM j UNION ALL SELECT 'l_tax', count(l_tax) FROM j UNION ALL SELECT 'rare', count(rare) FROM j) WHERE n >= 10
""")
def sparse_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns with fewer than ten values are dropped."""
    lines = table(spark, d, "lineitem").filter("l_linenumber = 6")
    joined = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_tax", F.when(F.col("l_orderkey") % 700 == 1, F.col("l_discount")).alias("rare"))
    return cohort.nonnull_counts(joined.select(*cohort.filled_columns(joined, 10))).withColumnRenamed("n_values", "n")


@query("SELECT c_custkey, 'mail [EMAIL] or call [PHONE], ssn [SSN], at [ADDRESS] today' AS shown FROM customer")
def contact_redaction(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    four = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    said = F.concat(F.lit("mail a"), k, F.lit("@b.org or call 555-123-"), four, F.lit(", ssn 123-45-"), four, F.lit(", at "), k, F.lit(" Old Mill Road today"))
    return table(spark, d, "customer").select("c_custkey", text.redact_contacts(said).alias("shown"))


@query("SELECT c_custkey, 'seen, [MRN] and [MRN]; known as MRN' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS shown FROM customer")
def mrn_redaction(spark: SparkSession, d: str) -> DataFrame:
    """What is a pseudonym already stays."""
    k = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    said = F.concat(F.lit("seen, MRN: A"), k, F.lit(" and medical record number "), k, F.lit("x; known as MRN"), k)
    return table(spark, d, "customer").select("c_custkey", text.redact_mrns(said).alias("shown"))


@query("SELECT c_custkey, 'X saw X; ' || c_name || 's friend' AS shown FROM customer")
def literal_replacement(spark: SparkSession, d: str) -> DataFrame:
    """The longest first, whole words, in any case."""
    said = F.concat(F.upper("c_name"), F.lit(" saw "), F.col("c_name"), F.lit(" Jr; "), F.col("c_name"), F.lit("s friend"))
    return table(spark, d, "customer").select("c_custkey", deid.literals_replaced(said, F.array(F.col("c_name"), F.concat("c_name", F.lit(" Jr")), F.lit("a")), "X").alias("shown"))


@query("""
SELECT o_orderkey, 'on ' || strftime(o_orderdate + INTERVAL (o_orderkey % 60 - 30) DAY, '%Y-%m-%d') || ', not 13/45/2020, then ' || strftime(o_orderdate + INTERVAL (o_orderkey % 60 - 30) DAY, '%Y-%m-%d') AS shown FROM orders
""")
def dates_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Dates inside texts, in ISO and US form, each row by its own days; what is no date stays."""
    said = F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", not 13/45/2020, then "), F.date_format("o_orderdate", "M/d/yyyy"))
    return table(spark, d, "orders").select("o_orderkey", deid.dates_moved(said, F.col("o_orderkey") % 60 - 30).alias("shown"))


@query("""
WITH i AS (SELECT DISTINCT 'K' || o_custkey AS identity FROM orders), n AS (SELECT identity, row_number() OVER (ORDER BY identity) AS k, CAST(('0x' || substr(sha256('s||' || identity || '||date_shift'), 1, 16))::UHUGEINT % 61 AS INTEGER) - 30 AS s FROM i)
SELECT o_orderkey, 'P' || lpad(CAST(k AS VARCHAR), 6, '0') AS patient_id, strftime(CAST(o_orderdate AS DATE) + s, '%Y-%m-%d') AS visit_date, CASE WHEN o_orderkey % 100 > 89 THEN '90+' ELSE CAST(o_orderkey % 100 AS VARCHAR) END AS age,
       'seen: P' || lpad(CAST(k AS VARCHAR), 6, '0') AS note, false AS needs_review
FROM orders JOIN n ON identity = 'K' || o_custkey
""")
def deidentified_table(spark: SparkSession, d: str) -> DataFrame:
    """Ids, dates, ages and notes by column class; the date of birth leaves."""
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("K"), "o_custkey").alias("patient_id"), F.lit("1960-01-01").alias("dob"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("visit_date"),
        (F.col("o_orderkey") % 100).alias("age"), F.concat(F.lit("seen: K"), "o_custkey").alias("note"),
    )
    classes = {"o_orderkey": "keep", "patient_id": "patient_id", "dob": "birth_date", "visit_date": "date", "age": "age", "note": "text"}
    keys = orders.select(deid.identity_key(F.col("patient_id"), None).alias("identity"), F.lit(None).cast("string").alias("sex"))
    return deid.deidentified(orders, classes, deid.identities(keys, "s", 30))


@query("SELECT o_orderkey, datediff('day', DATE '1960-02-29', CAST(o_orderdate AS DATE)) / 365.25::DOUBLE AS seen_years_since_birth, CAST(year(o_orderdate) AS INTEGER) AS seen_year FROM orders")
def years_since_birth(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("seen"), F.lit("1960-02-29").alias("born"))
    return deid.years_since_birth(orders, "born", ["seen"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey AS DOUBLE) END AS number, CASE WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def coerced_values(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and dates from texts; what is none becomes null."""
    third = F.col("o_orderkey") % 3
    raw = table(spark, d, "orders").select("o_orderkey", F.when(third == 0, F.lit("n/a")).otherwise(F.col("o_orderkey").cast("string")).alias("n"), F.when(third == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(third == 2, "2020-13-45").alias("t"))
    return raw.select("o_orderkey", values.TRANSFORMS["to_numeric"](F.col("n")).alias("number"), values.TRANSFORMS["to_date"](F.col("t")).alias("day"))


@query("SELECT o_orderkey, ['GSE1' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 4, '0'), 'GSE9999'] AS found FROM orders")
def accession_ids(spark: SparkSession, d: str) -> DataFrame:
    one = F.concat(F.lit("GSE1"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 4, "0"))
    return table(spark, d, "orders").select("o_orderkey", text.accessions(F.concat(F.lit("see "), one, F.lit(", GSE9999, GSE12 and "), one)).alias("found"))


@query("""
SELECT o_orderkey, CAST(i AS INTEGER) AS place, ['dx', 'rx'][i + 1] AS type, ['order ' || o_orderstatus, 'drug a'][i + 1] AS text FROM orders, range(0, 2) AS r(i)
""")
def event_tag_rows(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("lead <dx> order "), "o_orderstatus", F.lit("\n<rx>drug a <3"))
    return table(spark, d, "orders").select("o_orderkey", F.posexplode(text.event_tags(said)).alias("place", "event")).select("o_orderkey", "place", "event.type", "event.text")


@query("SELECT o_custkey, string_agg(o_orderstatus, ' ' ORDER BY o_orderkey) AS block FROM orders GROUP BY 1")
def patient_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A text of several patients, split at its marks."""
    joined = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]), " ").alias("t"))
    # Fifty patients a text at most, however many there are.
    whole = joined.groupBy(F.floor(F.col("o_custkey") / 50).alias("k")).agg(F.array_join(F.collect_list(F.concat(F.col("o_custkey").cast("string"), F.lit("|"), "t")), "<new_patient>").alias("t"))
    blocks = whole.select(F.explode(F.split("t", "<new_patient>")).alias("b"))
    return blocks.select(F.substring_index("b", "|", 1).cast("long").alias("o_custkey"), F.substring_index("b", "|", -1).alias("block"))


@query("SELECT o_orderkey, 'order ' || o_orderstatus AS summary, 'order' AS answer FROM orders")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Fences, a leading word, and what was thought before the answer go."""
    fenced = F.concat(F.lit("```text\nClinical Summary: order "), "o_orderstatus", F.lit("\n```"))
    thought = F.concat(F.lit("first </think> then ```json\nno\n``` and ```\norder\n```"))
    return table(spark, d, "orders").select("o_orderkey", text.summary(fenced).alias("summary"), notes.without_reasoning(thought).alias("answer"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 30) || ' ... ' || substr(text, length(text) - 29, 30) ELSE text END AS middle, substr(text, 1, 500) AS evidence FROM documents
""")
def clipped_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    clipped = codes.audit_trail(docs.select(F.col("doc_id").alias("value"), F.col("text").alias("evidence"), "text")).select(F.col("value").alias("doc_id"), "evidence")
    return docs.select("doc_id", text.middle_cut(F.col("text"), 60).alias("middle")).join(clipped, "doc_id")


@query("""
SELECT doc_id, CAST(i AS INTEGER) AS chunk, substr(text, CAST(i * 160 + 1 AS BIGINT), 200) AS piece
FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 200 THEN 1 ELSE CAST(ceil((length(text) - 200) / 160.0) AS BIGINT) + 1 END)) AS i FROM documents)
""")
def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of 50 tokens that overlap by 10, at about four characters a token, in texts without a mark to end at."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return notes.chunked_notes(docs, "text", 50, 10, by_tokens=True, marker="\u0001").select("doc_id", "chunk", "piece")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(site, '^C[0-9]{2,3}$') THEN 'valid' WHEN l_discount >= 0.05 THEN 'corrected' WHEN l_discount > 0 THEN 'warning' ELSE 'invalid' END AS status,
       histology BETWEEN 8000 AND 9989 AS histology_ok, CASE WHEN site IN ('C30', 'C34', 'C40', 'C41', 'C44', 'C47', 'C49', 'C50', 'C56') AND l_linenumber % 3 = 0 THEN 'paired site without side' END AS edit
FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'X' ELSE 'C' END || CAST(CAST(l_quantity AS BIGINT) + 10 AS VARCHAR) AS site, 7000 + l_partkey % 3500 AS histology FROM lineitem)
""")
def field_validation(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    site = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "X").otherwise("C"), (F.col("l_quantity").cast("long") + 10).cast("string"))
    side = F.when(F.col("l_linenumber") % 3 == 0, F.lit("9")).otherwise("1")
    return lines.select(
        "l_orderkey", "l_linenumber", codes.validation(codes.site_valid(site), F.when(F.col("l_discount") >= 0.05, 0.9).otherwise(F.col("l_discount"))).alias("status"),
        codes.histology_valid((7000 + F.col("l_partkey") % 3500).cast("string")).alias("histology_ok"), codes.laterality_edit(site, side).alias("edit"),
    )


@query("""
SELECT * FROM (VALUES (0, 'aggregate', true), (1, 'aggregate', false), (2, 'aggregate', false), (3, 'aggregate', false), (4, 'aggregate', false), (5, 'individual', true), (6, 'individual', true), (7, 'individual', false), (8, 'aggregate', false), (9, 'aggregate', false)) AS t(place, mode, allowed)
LEFT JOIN (SELECT 0 AS place, count(DISTINCT c_mktsegment) AS n_rows FROM customer UNION ALL SELECT 5, least(count(*), 5) FROM customer UNION ALL SELECT 6, count(*) FROM customer) USING (place)
""")
def gate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What the gate says of statements in either mode, and the rows of those that it lets through."""
    table(spark, d, "customer").createOrReplaceTempView("gate_judged")
    asked = [
        ("aggregate", "SELECT c_mktsegment, count(*) AS n FROM gate_judged GROUP BY c_mktsegment"), ("aggregate", "SELECT * FROM gate_judged"), ("aggregate", "SELECT c_acctbal FROM gate_judged"),
        ("aggregate", "SELECT min(c_custkey) AS m FROM gate_judged"), ("aggregate", "DROP TABLE gate_judged"), ("individual", "SELECT c_acctbal FROM gate_judged LIMIT 5"),
        ("individual", "SELECT c_acctbal FROM gate_judged"), ("individual", "SELECT c_custkey FROM gate_judged LIMIT 5"), ("aggregate", "SELECT c_mktsegment, collect_list(c_acctbal) AS l FROM gate_judged GROUP BY 1"),
        ("aggregate", "SELECT count(*) AS n FROM gate_judged UNION ALL SELECT c_nationkey FROM gate_judged"),
    ]
    said = [gate.examine(spark, sql, mode, ("c_custkey",)).allowed for mode, sql in asked]
    rows = [spark.sql(sql).agg(F.lit(i).alias("place"), F.count("*").alias("n_rows")) for i, (_, sql) in enumerate(asked) if said[i]]
    verdicts = spark.createDataFrame([(i, mode, said[i]) for i, (mode, _) in enumerate(asked)], "place int, mode string, allowed boolean")
    return verdicts.join(reduce(DataFrame.unionByName, rows), "place", "left")


@query("SELECT 'all' AS asked, true AS warned, count(*) AS n_rows FROM customer UNION ALL SELECT 'three', false, least(count(*), 3) FROM customer")
def limit_warnings(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "customer").createOrReplaceTempView("gate_limited")
    """Whether a statement is warned of its missing limit, and the rows it gives."""
    out = []
    for name, more in (("all", ""), ("three", " LIMIT 3")):
        sql = f"SELECT c_acctbal FROM gate_limited{more}"
        warned = "no LIMIT" in gate.examine(spark, sql, "individual").warnings
        out.append(spark.sql(sql).agg(F.lit(name).alias("asked"), F.lit(warned).alias("warned"), F.count("*").alias("n_rows")))
    return out[0].unionByName(out[1])


@query("""
SELECT * FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS patient_id, 'a' AS ontology, 'patient' AS category, -1 AS tumor_index, 0 AS instance, 'status' AS field, o_orderstatus AS value FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'unknown', 'regimen', 0, 0, 'drugs', 'x; ' || o_orderstatus FROM orders WHERE o_orderkey % 4 = 1
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'unknown', 'cancer_diagnosis', -1, 0, 'site', 'C50' FROM orders WHERE o_orderkey % 4 = 2
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'unknown', 'other', -1, 0, 'odd', '1' FROM orders WHERE o_orderkey % 4 = 2
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'unknown', 'cancer_diagnosis', 7, 0, 'stage', o_orderstatus FROM orders WHERE o_orderkey % 4 = 3
)
""")
def json_consolidation(spark: SparkSession, d: str) -> DataFrame:
    """Four layouts of extraction results as long rows."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    who = k.cast("string").alias("patient_id")
    layouts = (
        F.to_json(F.struct(who, F.lit("a").alias("ontology"), F.struct(F.struct(F.struct(s.alias("value"), F.lit(0.9).alias("confidence")).alias("status")).alias("patient")).alias("categories"))),
        F.to_json(F.struct(who, F.struct(F.array(F.struct(F.array(F.lit("x"), s).alias("drugs"))).alias("treatment_regimens")).alias("records"))),
        F.to_json(F.struct(who, F.struct(F.lit("C50").alias("site"), F.lit(1).alias("odd")).alias("results"))),
        F.to_json(F.struct(who, F.array(F.struct(s.alias("stage"), F.lit(7).alias("tumor_index"))).alias("diagnoses"))),
    )
    docs = table(spark, d, "orders").select(F.concat(F.lit("in/"), k, F.lit(".json")).alias("path"), F.get(F.array(*layouts), (k % 4).cast("int")).alias("text"))
    return extractions.consolidate(docs, {"site": "cancer_diagnosis"})


@query("""
SELECT p_partkey AS code, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_name END, p_brand) AS description, p_type AS category FROM part WHERE p_size % 2 = 0
""")
def loinc_table(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "part").select(
        F.col("p_partkey").alias("LOINC_NUM"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("LONG_COMMON_NAME"), F.col("p_brand").alias("SHORTNAME"), F.lit("c").alias("COMPONENT"),
        F.col("p_type").alias("CLASS"), F.when(F.col("p_size") % 4 == 0, "active").when(F.col("p_size") % 2 == 0, "Trial").otherwise("DEPRECATED").alias("STATUS"),
    )
    return tables.normalized_loinc(raw)


@query("""
SELECT l_orderkey AS code, coalesce(arg_min(l_shipdate, l_linenumber) FILTER (l_linenumber % 2 = 0), arg_min(l_shipdate, l_linenumber)) AS description
FROM (SELECT l_orderkey, l_linenumber, min(strftime(l_shipdate, '%Y%m%d')) AS l_shipdate FROM lineitem WHERE l_linenumber < 6 GROUP BY 1, 2) GROUP BY 1
""")
def snomed_table(spark: SparkSession, d: str) -> DataFrame:
    """Active concepts with their first synonym, or else their full name."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.date_format("l_shipdate", "yyyyMMdd")).alias("term"))
    synonym = F.when(F.col("l_linenumber") % 2 == 0, "900000000000013009").otherwise("900000000000003001")
    return tables.normalized_snomed(lines.select(F.col("l_orderkey").alias("conceptId"), synonym.alias("typeId"), "term", F.col("l_linenumber").alias("seq"), F.when(F.col("l_linenumber") < 6, "1").otherwise("0").alias("active")))


@query("""
SELECT a.l_orderkey, a.place, a.tumor, coalesce(i.code, p.code) AS code
FROM (SELECT l_orderkey, l_linenumber AS place, l_linenumber * 10 AS tumor FROM lineitem GROUP BY ALL) a
LEFT JOIN (SELECT l_orderkey, 10 AS tumor, 'C2' AS code FROM lineitem WHERE l_linenumber = 2 GROUP BY ALL) i ON a.l_orderkey = i.l_orderkey AND a.tumor = i.tumor
LEFT JOIN (SELECT l_orderkey, l_linenumber AS place, 'C' || l_linenumber AS code FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL) p ON a.l_orderkey = p.l_orderkey AND a.place = p.place
""")
def code_positions(spark: SparkSession, d: str) -> DataFrame:
    """Codes of a second step beside the rows of a first: by index, else by place."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("place")).distinct()
    plain = lines.withColumn("tumor", F.col("place") * 10)
    coded = lines.filter("place <= 2").select("l_orderkey", "place", F.when(F.col("place") == 2, 10).alias("tumor"), F.concat(F.lit("C"), "place").alias("code"))
    return notes.merged_codes(plain, coded, "l_orderkey", "tumor", "place", ["code"])


@query("""
WITH t AS (SELECT DISTINCT CAST(floor(o_totalprice / 100000) AS INTEGER) AS t FROM orders), s AS (SELECT CAST(floor(o_totalprice / 100000) AS INTEGER) AS stop, CAST(o_orderkey % 4 AS INTEGER) AS entry FROM orders)
SELECT t.t, count(*) AS at_risk FROM t JOIN s ON s.entry < t.t AND t.t <= s.stop GROUP BY 1
""")
def risk_sets(spark: SparkSession, d: str) -> DataFrame:
    """Who has entered before a time and is still followed at it."""
    s = table(spark, d, "orders").select(F.floor(F.col("o_totalprice") / 100000).cast("int").alias("stop"), (F.col("o_orderkey") % 4).cast("int").alias("entry"))
    return survival.risk_sets(s, "entry", "stop")


@query("""
WITH j AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS p, l_tax FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 5) l ON o_orderkey = l_orderkey)
SELECT 'p' AS column_name, count(p) AS n_values, round(100.0 * (count(*) - count(p)) / count(*), 6)::DOUBLE AS missing_pct FROM j
UNION ALL SELECT 'l_tax', count(l_tax), round(100.0 * (count(*) - count(l_tax)) / count(*), 6)::DOUBLE FROM j
""")
def missingness_report(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_linenumber = 5")
    joined = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("p"), "l_tax")
    flags = derive.quality_flags(joined, ["p", "l_tax"]).select("column_name", F.round(F.col("missing_share") * 100, 6).alias("missing_pct"))
    return cohort.nonnull_counts(joined).join(flags, "column_name")


@query("""
SELECT o_custkey, round(min(y) , 9) AS entry_time, round(max(y) - min(y), 9) AS overall_time, round(min(y) FILTER (o_orderstatus = 'F') - min(y), 9) AS time_to_treatment
FROM (SELECT *, (CAST(o_orderdate AS DATE) - DATE '1960-01-01') / 365.25::DOUBLE AS y FROM orders) GROUP BY 1
""")
def follow_up_times(spark: SparkSession, d: str) -> DataFrame:
    """Entry, overall time and time to the first treatment, as differences of years since birth."""
    y = values.years_whole_days(F.col("o_orderdate"), F.lit("1960-01-01").cast("date"))
    t = table(spark, d, "orders").withColumn("y", y).groupBy("o_custkey").agg(F.min("y").alias("a"), F.max("y").alias("b"), F.min(F.when(F.col("o_orderstatus") == "F", F.col("y"))).alias("f"))
    return t.select("o_custkey", F.round("a", 9).alias("entry_time"), F.round(F.col("b") - F.col("a"), 9).alias("overall_time"), F.round(F.col("f") - F.col("a"), 9).alias("time_to_treatment"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' -- ' || p_type || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS column_name FROM part")
def column_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.column_name(F.concat("p_name", F.lit(" -- "), "p_type", F.lit("!"))).alias("column_name"))
