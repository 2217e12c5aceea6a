"""Readers and writers of tables, notes and reference files."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import padded
from tessella.operators.cohort import aligned


def read_table(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """Parquet, ORC, JSON lines, CSV or TSV by suffix."""
    suffix = path.rsplit("/", 1)[-1].removesuffix(".gz").rpartition(".")[2].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "orc":
        return spark.read.orc(path)
    if suffix in ("json", "jsonl"):
        return spark.read.json(path, multiLine=suffix == "json", allowUnquotedControlChars=True)
    if suffix in ("csv", "tsv", "txt"):
        return spark.read.csv(path, header=True, inferSchema=infer, sep="," if suffix == "csv" else "\t", quote='"', escape='"', multiLine=True)
    raise ValueError(f"{path}: not a table format that is read here")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    suffix = path.rpartition(".")[2].lower()
    if suffix == "csv":
        df.write.csv(path, mode=mode, header=True, escape='"')
    elif suffix == "tsv":
        df.write.csv(path, mode=mode, header=True, sep="\t", escape='"')
    elif suffix in ("json", "jsonl"):
        df.write.json(path, mode=mode)
    elif suffix == "parquet":
        df.write.parquet(path, mode=mode)
    else:
        raise ValueError(f"{path}: not a table format that is written here")


def read_table_in_order(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """A table with source_file and source_row, which hold file order before any shuffle."""
    df = read_table(spark, path, infer)
    return df.select("*", F.col("_metadata.file_name").alias("source_file"), F.monotonically_increasing_id().alias("source_row"))


def discover(paths: list[str], extensions: tuple[str, ...] = ("csv", "tsv", "parquet")) -> list[str]:
    """Files of local paths and folders, each once, by name."""
    found = {}
    for p in map(Path, paths):
        for f in sorted(p.iterdir()) if p.is_dir() and p.suffix != ".parquet" else [p]:
            if f.suffix.lstrip(".").lower() in extensions:
                found.setdefault(f.resolve(), f)
    return [str(f) for f in sorted(found.values(), key=lambda f: f.name)]


def read_json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each JSON file, control characters allowed."""
    return spark.read.option("multiLine", True).option("allowUnquotedControlChars", True).json(f"{folder}/*.json")


def read_rounds(spark: SparkSession, path: str) -> DataFrame:
    """Round checkpoints as JSON lines; broken lines are skipped; the last line of a patient and round, by file name and place, wins."""
    schema = "patient_id string, round int, extraction string, num_chunks int"
    # Ids grow along the rows of a task, which reads one block of a file from its start to its end.
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", place.alias("_line")).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "_line").select("r.*", "_line").filter(F.col("patient_id").isNotNull())
    return rows.groupBy("patient_id", "round").agg(F.max_by(F.struct("extraction", "num_chunks"), "_line").alias("r")).select("patient_id", "round", "r.*")


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path)
    for c, kind in (("blurb", "string"), ("n_patients", "int"), ("label", "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    return df.select("blurb", F.coalesce(F.col("n_patients").cast("int"), F.lit(5)).alias("n_patients"), "label")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """code, description, category; rows without code or description go."""
    df = read_table(spark, path, infer=False)
    if "category" not in df.columns:
        df = df.withColumn("category", F.lit(None).cast("string"))
    return df.select(F.trim("code").alias("code"), F.trim("description").alias("description"), "category").filter("code != '' and description != ''")


def code_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(code, description) of lines ``CODE  description``."""
    return lines.select(F.regexp_extract(value, r"^(\S+)\s+(.*\S)\s*$", 1).alias("code"), F.regexp_extract(value, r"^(\S+)\s+(.*\S)\s*$", 2).alias("description")).filter("code != ''")


def normalized_loinc(df: DataFrame) -> DataFrame:
    active = F.upper(F.coalesce("STATUS", F.lit("ACTIVE"))).isin("ACTIVE", "TRIAL")
    return df.filter(active).select(F.col("LOINC_NUM").alias("code"), F.coalesce("LONG_COMMON_NAME", "SHORTNAME", "COMPONENT").alias("description"), F.col("CLASS").alias("category"))


def normalized_snomed(descriptions: DataFrame) -> DataFrame:
    """Active concepts with their first synonym, or else their full name, in file order."""
    kind = F.when(F.col("typeId") == "900000000000013009", 0).otherwise(1)  # the fixed id of a synonym
    best = F.min_by("term", F.struct(kind, "seq"))
    return descriptions.filter("active = '1'").groupBy(F.col("conceptId").alias("code")).agg(best.alias("description"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """question and options (from a trailing ``(a; b; c)``), one a line; ``#`` starts a comment."""
    line = F.trim("value")
    lines = spark.read.text(path).filter((line != "") & ~line.startswith("#"))
    options = F.regexp_extract(line, r"\(([^()]*;[^()]*)\)\s*$", 1)
    return lines.select(
        F.when(options == "", line).otherwise(F.trim(F.regexp_replace(line, r"\([^()]*;[^()]*\)\s*$", ""))).alias("question"),
        F.when(options == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(options, ";"), lambda x: F.trim(x))).alias("options"),
    )


def read_drug_map(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path, infer=False)
    return df.select(F.trim("generic").alias("generic"), F.filter(F.transform(F.split("alternatives", r"\|"), lambda x: F.trim(x)), lambda x: x != "").alias("alternatives"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Registry items whose number is a whole number; retired ones are marked."""
    df = read_table(spark, path, infer=False)
    number = F.col("item_number").try_cast("int")
    return df.filter(number.isNotNull()).withColumn("item_number", number).withColumn("active", F.coalesce(F.trim("year_retired"), F.lit("")) == "")


def inspected(df: DataFrame) -> DataFrame:
    """n_rows, null fraction of all cells, n_columns and a verdict; one pass over all rows."""
    n = len(df.columns)
    filled = F.avg(sum((F.col(f"`{c}`").isNotNull().cast("int") for c in df.columns), F.lit(0)) / F.lit(float(n or 1)))
    verdict = F.when(F.col("n_rows") == 0, "empty").when(F.col("null_fraction") > 0.5, "mostly missing").when((F.lit(n) < 2) | (F.col("n_rows") < 3), "too small").otherwise("usable")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(1 - filled, F.lit(0.0)).alias("null_fraction")).withColumn("n_columns", F.lit(n)).withColumn("verdict", verdict)


def save_database(frames: dict[str, DataFrame], folder: str, only: set[str] | None = None) -> None:
    """Each table as parquet, replaced, and a view of its name; only approved tables if a set is given."""
    for name, df in frames.items():
        if only is None or name in only:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            df.sparkSession.read.parquet(f"{folder}/{name}").createOrReplaceTempView(name)


def append_aligned(existing: DataFrame, more: DataFrame) -> DataFrame:
    return aligned(existing, more)


def catalog(spark: SparkSession, hidden: tuple[str, ...] = ("record_id",)) -> list[tuple[str, str, str]]:
    """(table, column, type) of all views, without hidden columns."""
    return [(t.name, f.name, f.dataType.simpleString()) for t in spark.catalog.listTables() for f in spark.table(t.name).schema if f.name.lower() not in hidden]


def summaries(frames: dict[str, DataFrame], key: str = "record_id") -> DataFrame:
    """Rows, columns and distinct patients of each table, in one plan."""
    parts = []
    for name, df in frames.items():
        patients = F.countDistinct(key) if key in df.columns else F.lit(None).cast("long")
        parts.append(df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), patients.alias("n_patients")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fixed_width(items: DataFrame, key: str, number: str, value: str, layout: list[tuple[int, int]]) -> DataFrame:
    """(key, record): the items of each key in number order, each padded or cut to its width."""
    first = items.groupBy(key).pivot(number, [n for n, _ in layout]).agg(F.first(value))
    return first.select(key, F.concat(*(padded(F.col(f"`{n}`"), size) for n, size in sorted(layout))).alias("record"))


def registry_table(items: DataFrame, key: str, number: str, value: str, names: dict[int, str]) -> DataFrame:
    """One row a patient, one column an item, headed ``Name [number]``."""
    wide = items.groupBy(key).pivot(number, sorted(names)).agg(F.first(value))
    return wide.select(key, *(F.col(f"`{n}`").alias(f"{names[n]} [{n}]") for n in sorted(names)))


def write_registry_xml(items: DataFrame, path: str) -> None:
    """NaaccrData of Patient of Tumor of Item, by Spark's XML writer; items: patient_id, tumor, naaccr_id, value."""
    item = F.struct(F.col("naaccr_id").alias("_naaccrId"), F.col("value").alias("_VALUE"))
    tumors = items.groupBy("patient_id", "tumor").agg(F.array_sort(F.collect_list(item)).alias("Item"))
    patients = tumors.groupBy("patient_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tumor", "Item"))), lambda t: F.struct(t["Item"].alias("Item"))).alias("Tumor"))
    patients.select(F.col("patient_id").alias("_patientId"), "Tumor").write.mode("overwrite").format("xml").options(rootTag="NaaccrData", rowTag="Patient").save(path)


def ordered_columns(df: DataFrame, schema: list[str]) -> DataFrame:
    return df.select(*(c for c in schema if c in df.columns), *(c for c in df.columns if c not in schema))


def summary_markdown(summary: DataFrame) -> str:
    """A small table as Markdown."""
    rows = [summary.columns, ["---"] * len(summary.columns), *([str(v) for v in r] for r in summary.orderBy(summary.columns[0]).collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def latest_first(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def is_data_file(name: Column) -> Column:
    """Data extensions, or text files named data, table or matrix."""
    return name.rlike(r"(?i)\.(csv|tsv|xlsx?|h5|h5ad|mtx|parquet|rds|gz|zip)$") | name.rlike(r"(?i)(data|table|matrix)[^/]*\.txt$")


def safe_name(name: str) -> str:
    out = re.sub("[^0-9a-z]+", "_", name.lower()).strip("_")
    return f"t_{out}" if out[:1].isdigit() else out or "unknown"


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, value), from 0, of a coordinate matrix file; comments and the line of sizes are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"), F.monotonically_increasing_id().alias("n")).filter((F.col("v") != "") & ~F.col("v").startswith("%"))
    sizes = lines.agg(F.min("n")).first()[0]
    parts = F.split("v", r"\s+")
    cells = lines.filter(F.col("n") != sizes).select(parts.alias("p"))
    return cells.select((F.get("p", F.lit(0)).cast("long") - 1).alias("row"), (F.get("p", F.lit(1)).cast("long") - 1).alias("column"), F.coalesce(F.get("p", F.lit(2)).cast("double"), F.lit(1.0)).alias("value"))
