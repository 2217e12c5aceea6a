"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n documents and share w of the target of T documents has the repetition rate T * w / n; w is in
proportion to given weights, or to n ** ``TEMPER`` times a boost by the source's name. Each
document draws u from md5(seed, doc_id) and is repeated as often as the Poisson distribution with that mean
exceeds at u (inversion), so the outcome depends on neither partitioning nor retries. Copies are then shuffled
globally by md5(seed, doc_id, copy): dealt to partitions by it and sorted inside them.

Defined cases: a null source is a source of its own; a source without a target weight gets rate 0; a null doc_id
draws by its text; repeated rows draw alike; an empty table stays empty; a source may have any rate, but a target of
over ``MOST_RATE`` times the documents that came in raises an error (the default target never does); extra columns pass through; columns named copy, order_key, _copies, _salt, _s, _upto or _first are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import staged

SEED = "mix-1"
#: The mixture that the query and the pipeline aim at: these sources weigh so many times what their tempered count says,
#: all others once.
BOOSTS = {"src0": 0.5, "src1": 3.0, "src2": 2.0, "src3": 1.5, "src4": 0.25}
#: Share of a source in the target is in proportion to its count to this power.
TEMPER = 0.5
#: A rate table of no more sources and steps than these is broadcast; a larger one is joined with salt.
BROADCAST_SOURCES = 5000
BROADCAST_STEPS = 2_000_000
SALTS = 32


def tempered(counts: DataFrame, boosts: dict[str, float] | None = None, power: float = TEMPER) -> DataFrame:
    """(source, weight) with weights in proportion to count ** power, times the boost that a source is given by name."""
    boost = F.lit(1.0)
    for name, times in (boosts or {}).items():
        boost = F.when(F.col("source") == name, times).otherwise(boost)
    return counts.select("source", (F.pow(F.col("n").cast("double"), F.lit(power)) * boost).alias("weight"))


def first_step(rate: Column) -> Column:
    """The least k with a probability that doubles can tell."""
    return F.greatest(F.lit(0), F.floor(rate - 10 * F.sqrt(rate) - 20).cast("int"))


def poisson_steps(rate: Column) -> Column:
    """P(X <= k) of a Poisson variable, from first_step up to where nothing is left to doubles.

    Weights are taken from the mode on down and up, so none that counts underflows, and are then divided by their sum.
    """
    first, mode, last = first_step(rate), F.floor(rate).cast("int"), F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.lit(1.0).alias("p"), F.array(F.lit(1.0)).alias("all"))

    def on(acc: Column, p: Column) -> Column:
        return F.struct(p.alias("p"), F.array_append(acc["all"], p).alias("all"))

    below = F.when(
        mode > first,
        F.aggregate(F.sequence(mode, F.greatest(first + 1, F.lit(1)), F.lit(-1)), start, lambda acc, k: on(acc, acc["p"] * k / rate), lambda acc: acc["all"]),
    ).otherwise(F.array(F.lit(1.0)))
    above = F.aggregate(F.sequence(mode + 1, last), start, lambda acc, k: on(acc, acc["p"] * rate / k), lambda acc: F.slice(acc["all"], 2, last))
    weights = F.concat(F.reverse(below), above)
    # The whole sum is known when all have been added: it divides them once, at the end.
    return F.aggregate(
        weights,
        F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("upto")),
        lambda acc, w: F.struct((acc["sum"] + w).alias("sum"), F.array_append(acc["upto"], acc["sum"] + w).alias("upto")),
        lambda acc: F.transform(acc["upto"], lambda x: x / acc["sum"]),
    )


def unit_interval(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def salt() -> Column:
    """Deals the rows of one source; rows without an id are dealt by their text."""
    return F.pmod(F.coalesce(F.xxhash64("doc_id", "text"), F.lit(0)), F.lit(SALTS)).cast("int")


def mix(docs: DataFrame, weights: DataFrame | None = None, target: float | None = None, seed: str = SEED, boosts: dict[str, float] | None = None) -> DataFrame:
    """``docs`` repeated to the target weights, with copy (from 0) and order_key, in globally shuffled order.

    ``weights``: (source, weight), any scale; by default tempered counts with ``boosts``. ``target``: documents aimed at,
    by default as many as there are.
    """
    kept = [c for c in docs.columns if c.lower() not in ("copy", "order_key", "_copies", "_salt", "_s", "_upto", "_first")]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    counts = staged(docs.groupBy("source").agg(F.count("*").alias("n")), "sources")
    wanted = (weights if weights is not None else tempered(counts, boosts)).select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
    both = counts.join(wanted, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = both.agg(F.sum(F.col("weight")), F.sum("n"), F.count("*"), F.sum(F.sqrt(F.col("weight") / F.col("n")))).first()
    aim = float(target if target is not None else total[1] or 0)
    n_steps = 40 * (total[2] or 0) + 20 * (aim / (total[0] or 1.0)) ** 0.5 * (total[3] or 0)
    rate = F.lit(aim) * F.col("weight") / F.lit(total[0] or 1.0) / F.col("n")
    steps = both.withColumn("rate", rate).select(
        F.col("source").alias("_s"),
        first_step(F.col("rate")).alias("_first"),
        poisson_steps(F.col("rate")).alias("_upto"),
    )
    if (total[2] or 0) <= BROADCAST_SOURCES and n_steps <= BROADCAST_STEPS:
        rated = docs.join(F.broadcast(steps), F.col("source").eqNullSafe(F.col("_s")), "left")
    else:
        steps = steps.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn("_salt", salt())
        rated = dealt.join(steps, F.col("source").eqNullSafe(F.col("_s")) & (dealt["_salt"] == steps["_salt"]), "left").drop(dealt["_salt"]).drop(steps["_salt"])
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    drawn = unit_interval(F.lit(seed), key)
    copies = F.col("_first") + F.size(F.filter("_upto", lambda p: p <= drawn))
    spread = rated.withColumn("_copies", copies).filter("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    ordered = spread.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(seed), key, F.col("copy").cast("string")).cast("binary")))
    return ordered.select(*(F.col(f"`{c}`") for c in kept), "copy", "order_key").repartition("order_key").sortWithinPartitions("order_key")
