"""A training corpus from ``documents``: language ID, near-dedup, substring dedup, mixing, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor and, but for the last, returns the
columns of documents. ``run`` writes each stage to the shared folder, reads it again, and deletes what the stage has
staged and the table before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, langid, mixing, simhash, spans
from tessella.llm.shared import released, staged, staged_so_far

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less sure than this go; ``und`` has score 0.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that the model is sure of, go.

    Null and empty texts go; a null lang or doc_id teaches nothing, and the row is judged by its text like any other;
    rows that share a doc_id are each judged by their own text; an empty table stays empty; extra columns are dropped.
    """
    return langid.predict(docs, langid.fit(docs)).filter(F.col("score") >= LEAST_SCORE).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest doc_id stays, once.

    Null and empty texts are one group. Rows that share a doc_id are told apart by their fingerprints: each group keeps
    the row with the smallest (doc_id, fingerprint), rows without an id after all others, and of rows equal in both the one with
    the smallest hash of its text, then lang, then source. Extra columns are dropped.
    """
    judged = staged(simhash.near_duplicates(docs, groups=True), "judged")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fingerprint"))
    first = staged(judged.groupBy("component").agg(least.alias("first")).select("first.*"), "first")
    rows = judged.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    leaders = staged(first.filter("not nameless").drop("nameless").join(rows, "doc_id"), "leaders")
    docs = docs.select(COLUMNS)
    # Texts are streamed past the hashed ids: no sort of whole documents.
    kept = docs.join(leaders.filter("rows = 1").hint("shuffle_hash"), "doc_id", "left_semi")
    one = F.min_by(F.struct(*COLUMNS), F.struct(F.xxhash64("text"), "lang", "source")).alias("one")
    repeated = leaders.filter("rows > 1").select("doc_id", "fingerprint")
    if not repeated.isEmpty():
        again = simhash.with_fingerprints(docs.join(repeated.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi"))
        again = again.join(repeated.hint("shuffle_hash"), ["doc_id", "fingerprint"], "left_semi")
        kept = kept.unionByName(again.groupBy("doc_id", "fingerprint").agg(one).select("one.*"))
    nameless = first.filter("nameless").select("fingerprint")
    if not nameless.isEmpty():
        # Copies are put together before they are shuffled.
        again = simhash.with_fingerprints(docs.filter("doc_id is null")).groupBy("fingerprint").agg(one)
        kept = kept.unionByName(again.join(nameless, "fingerprint", "left_semi").select("one.*"))
    return kept.select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated sentence spans go; a document of which nothing is left goes with them.

    Null and empty texts stay as they are; rows that share a doc_id count as one document; rows with a null doc_id take
    part in no comparison between documents; n_chars is counted anew; extra columns are dropped.
    """
    cut = spans.dedup(docs).filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate calls for, in shuffled order.

    A null source is a source of its own; a null doc_id draws by its text; rows that share a doc_id draw alike; null and
    empty texts are mixed like any other; an empty table stays empty; extra columns are dropped.
    """
    return mixing.mix(docs, boosts=mixing.BOOSTS).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of what they decode to.

    A null text is empty: no ids. Every row is encoded on its own, so repeated rows and null ids need no rule; an empty
    table stays empty; of the columns doc_id, lang and source are kept.
    """
    return bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), ids=True).drop("text")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokenize),
]

#: Trained classifiers and connected components are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged_so_far()
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        released(spark, before, docs)
    return docs
