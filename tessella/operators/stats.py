"""Profiles, survival and tests, by aggregates that run over pre-aggregated tables dealt by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.cohort import range_count, range_number
from tessella.session import written


def quantiles(df: DataFrame, key: str, value: str, shares: list[float]) -> dict[object, list[float]]:
    """Exact interpolated quantiles of a value in each group, for groups that are few and values that may be many.

    Distinct values are counted first, dealt by range, and counted by partition; only the partitions that hold a wanted
    rank are then walked. No task holds a group, and the driver sees two values for each quantile.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    # Written, since a partition that is dealt anew after a lost executor may hold other values.
    ranged = written(counts.repartitionByRange("_k", "_v").withColumn("_part", F.spark_partition_id()), "ranged")
    sums: dict[object, list[tuple[int, int]]] = {}
    for r in ranged.groupBy("_k", "_part").agg(F.sum("_n").alias("n")).collect():
        sums.setdefault(r["_k"], []).append((r["_part"], r["n"]))
    wanted, places = [], {}
    for k, parts in sums.items():
        total = sum(n for _, n in parts)
        places[k] = [(int((total - 1) * p), (total - 1) * p % 1) for p in shares]
        ranks = sorted({x for at, rest in places[k] for x in ([at, at + 1] if rest else [at])})
        before = 0
        for part, n in sorted(parts):
            wanted += [(k, part, before, x) for x in ranks if before <= x < before + n]
            before += n
    if not wanted:
        return {}
    kind = df.schema[key].dataType.simpleString()
    ranks = df.sparkSession.createDataFrame(wanted, f"_k {kind}, _part int, _before long, _rank long")
    parts = ranks.select("_k", "_part", "_before").distinct()
    walked = ranged.join(F.broadcast(parts), ["_k", "_part"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy("_k", "_part").orderBy("_v")))
    hit = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))
    found = {(r["_k"], r["_rank"]): r["_v"] for r in walked.join(F.broadcast(ranks.drop("_before")), ["_k", "_part"]).filter(hit).select("_k", "_rank", "_v").collect()}
    return {k: [found[k, at] + (found[k, at + 1] - found[k, at]) * rest if rest else found[k, at] for at, rest in places[k]] for k in places}


#: Distinct values of a bracket that are gathered at most, and how far a bracket reaches beyond a rank, as a share.
GATHERED, REACH = 20_000, 0.003


def ranked_quantiles(df: DataFrame, columns: dict[str, tuple[Column, int]], shares: list[float]) -> dict[str, list[float]]:
    """Exact interpolated quantiles of whole columns; {name: (number, count of its values)}.

    Approximate quantiles bracket the wanted ranks; the values of a bracket are gathered when they are few, else the
    bracket is bracketed again, a 150th of its rows at a time.
    """
    if not columns:
        return {}
    named = {c: v for c, (v, _) in columns.items()}
    places = {(c, p): ((n - 1) * p, None, None) for c, (_, n) in columns.items() for p in shares}
    kept: dict[tuple[str, float], list[float]] = {}
    inside = df.select(*(v.alias(c) for c, v in named.items()))
    while places:
        keys = list(places)
        narrowed = {}
        for c in {c for c, _ in keys}:
            # The first brackets of all shares of a column come from one pass.
            same = [k for k in keys if k[0] == c]
            for group in [same] if places[same[0]][1] is None else [[k] for k in same]:
                _, low, high = places[group[0]]
                part = inside if low is None else inside.filter(F.col(c).between(low, high))
                n = columns[c][1] if low is None else part.count()
                before = 0 if low is None else inside.filter(F.col(c) < low).count()
                probes = [min(1.0, max(0.0, (places[k][0] - before) / n + side * (REACH + 2 / n))) for k in group for side in (-1, 1)]
                ends = part.approxQuantile(c, probes, REACH / 3)
                narrowed |= {k: (ends[2 * i], ends[2 * i + 1]) for i, k in enumerate(group)}
        within = lambda k: F.col(k[0]).between(*narrowed[k])
        below = inside.agg(*(F.count(F.when(F.col(k[0]) < narrowed[k][0], 1)).alias(f"b{i}") for i, k in enumerate(keys))).first()
        marked = F.array_compact(F.array(*(F.when(within(k), F.struct(F.lit(i).alias("k"), F.col(k[0]).alias("v"))) for i, k in enumerate(keys))))
        counts = inside.select(F.explode(marked).alias("m")).groupBy("m.k", "m.v").agg(F.count("*").alias("n"))
        gathered: dict[int, list[tuple[float, int]]] = {}
        for r in counts.limit(GATHERED * len(keys) + 1).collect():
            gathered.setdefault(r["k"], []).append((r["v"], r["n"]))
        whole = sum(map(len, gathered.values())) <= GATHERED * len(keys)
        for i, k in enumerate(keys):
            place = places[k][0]
            if not whole and narrowed[k][0] < narrowed[k][1]:
                places[k] = (place, *narrowed[k])
                continue
            # A bracket of one value holds the rank whatever the others are.
            values, at = sorted(gathered[i]) if whole else [(narrowed[k][0], columns[k[0]][1])], below[f"b{i}"]
            picked = []
            for rank in (int(place), int(place) + (place % 1 > 0)):
                upto = at
                for v, n in values:
                    upto += n
                    if rank < upto:
                        picked.append(v)
                        break
            kept[k] = [picked[0] + (picked[-1] - picked[0]) * (place % 1)]
            del places[k]
    return {c: [kept[c, p][0] for p in shares] for c in columns}


#: A column of no more distinct values than these has its quantiles from one aggregate, whose state holds each value once.
NARROW = 50_000


def five_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, least, largest, mean, median and quartiles of each column, one row a column.

    One pass tells counts and how many values are distinct; columns of few get their quantiles from a second, all others
    from brackets that are narrowed until few values are left in them.
    """
    named = {c: F.col(f"`{c}`").cast("double") for c in columns}
    shares = [0.5, 0.25, 0.75]
    plain = df.agg(*(f(v).alias(f"{k}{i}") for i, v in enumerate(named.values()) for k, f in (("n", F.count), ("least", F.min), ("largest", F.max), ("mean", F.avg), ("d", F.approx_count_distinct)))).first()
    narrow = [c for i, c in enumerate(columns) if plain[f"d{i}"] <= NARROW]
    found = dict(zip(narrow, df.agg(*(F.percentile(named[c], F.array(*map(F.lit, shares))).alias(f"q{i}") for i, c in enumerate(narrow))).first())) if narrow else {}
    found |= ranked_quantiles(df, {c: (named[c], plain[f"n{i}"]) for i, c in enumerate(columns) if c not in narrow}, shares)
    rows = [(c, plain[f"n{i}"], plain[f"least{i}"], plain[f"largest{i}"], plain[f"mean{i}"], *(found.get(c) or [None] * 3)) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "column_name string, n_values long, least double, largest double, mean double, median double, q1 double, q3 double")


#: Ranges into which running aggregates are dealt at most.
RANGES = 128


def _number(df: DataFrame, order: str) -> Column:
    return (F.unix_date(order) if df.schema[order].dataType.typeName() == "date" else F.col(order)).cast("double")


def range_bounds(df: DataFrame, order: str) -> list[float]:
    """Borders between about equally many rows of ``df`` in the order of a number or date."""
    n = range_count(df, RANGES)
    return sorted(set(df.select(_number(df, order).alias("_o")).approxQuantile("_o", [i / n for i in range(1, n)], 0.002))) if n > 1 else []


def running(
    df: DataFrame, order: str, wanted: dict[str, tuple[str, Column]], descending: bool = False, strict: bool = False, by: str | None = None, bounds: list[float] | None = None
) -> DataFrame:
    """``df`` with running aggregates in the order of a number or date: {name: ("sum" or "min", column)}; ``order`` has no ties.

    Rows are dealt by ranges of the order (and by ``by``), run inside each, and are offset by what the ranges before
    amount to, so no task sees all rows. ``strict``: without the row itself; null where nothing stands before.
    ``bounds``: borders found for the same order before.
    """
    total = {"sum": F.sum, "min": F.min}
    both = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "min": F.least}
    number = _number(df, order)
    bounds = range_bounds(df, order) if bounds is None else bounds
    parts = df.withColumn("_part", range_number(number, bounds))
    keys = [by, "_part"] if by else ["_part"]
    sums = parts.groupBy(*keys).agg(*(total[kind](c).alias(f"_of_{name}") for name, (kind, c) in wanted.items()))
    # At most RANGES rows for each value of ``by``: what each range is offset by is summed up here.
    table, seen = [], {}
    for row in sorted(sums.collect(), key=lambda r: -r["_part"] if descending else r["_part"]):
        held = seen.setdefault(row[by] if by else None, dict.fromkeys(wanted))
        table.append((*(row[k] for k in keys), *held.values()))
        for name, (kind, _) in wanted.items():
            own, upto = row[f"_of_{name}"], held[name]
            if own is not None:
                held[name] = own if upto is None else upto + own if kind == "sum" else min(upto, own)
    renamed = [(f.name.replace("_of_", "_to_", 1), f.dataType.simpleString()) for f in sums.schema.fields]
    before = df.sparkSession.createDataFrame(table, ", ".join(f"`{n}` {t}" for n, t in renamed))
    inside = Window.partitionBy(*keys).orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    own = parts.select("*", *(total[kind](c).over(inside).alias(f"_in_{name}") for name, (kind, c) in wanted.items()))
    joined = own.join(F.broadcast(before), keys)
    return joined.select(*df.columns, *(both[kind](F.col(f"_to_{name}"), F.col(f"_in_{name}")).alias(name) for name, (kind, _) in wanted.items()))


def top_values(df: DataFrame, column: str, limit: int = 15) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), F.asc(column)).limit(limit)


def entropy(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Bits of the distribution of non-null values, in each group."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    # sum(-n/N log2(n/N)) = log2(N) - sum(n log2 n)/N needs no second pass for N.
    return counts.groupBy(*by).agg((F.log2(F.sum("_n").cast("double")) - F.sum(F.col("_n") * F.log2(F.col("_n").cast("double"))) / F.sum("_n")).alias("entropy"))


def kaplan_meier(df: DataFrame, time: str, event: str, entry: str | None = None) -> DataFrame:
    """time, at_risk, events, survival at each event time; with ``entry``, only those entered before are at risk.

    Aggregates run over one row for each distinct time, dealt by ranges of time.
    """
    times = written(df.groupBy(F.col(time).alias("t")).agg(F.count("*").alias("m"), F.sum(F.col(event).cast("long")).alias("d")), "times")
    bounds = range_bounds(times, "t")
    if entry is None:
        table = running(times, "t", {"n": ("sum", F.col("m"))}, descending=True, bounds=bounds)
    else:
        entered = df.groupBy(F.col(entry).alias("t")).agg(F.count("*").alias("e"))
        both = times.select("t", "m", "d", F.lit(0).alias("e")).unionByName(entered.select("t", F.lit(0).alias("m"), F.lit(0).alias("d"), "e"))
        both = written(both.groupBy("t").agg(F.sum("m").alias("m"), F.sum("d").alias("d"), F.sum("e").alias("e")), "entries")
        inside = running(both, "t", {"n": ("sum", F.col("e") - F.col("m"))}, strict=True, bounds=bounds)
        table = inside.withColumn("n", F.coalesce("n", F.lit(0)))
    steps = table.filter("d > 0").withColumn("f", 1 - F.col("d") / F.col("n"))
    steps = running(steps, "t", {"lowest": ("min", F.col("f")), "logs": ("sum", F.when(F.col("f") > 0, F.ln("f")))}, bounds=bounds)
    # Once everyone at risk has had the event, survival stays zero.
    survival = F.when(F.col("lowest") > 0, F.exp("logs")).otherwise(0.0)
    return steps.select(F.col("t").alias("time"), F.col("n").alias("at_risk"), F.col("d").alias("events"), survival.alias("survival"))


def cumulative_incidence(df: DataFrame, time: str, cause: str) -> DataFrame:
    """Aalen-Johansen for causes 1, 2, ...; 0 is censored. time, cause, incidence at each time of that cause."""
    times = written(df.groupBy(F.col(time).alias("t")).agg(F.count("*").alias("m"), F.sum((F.col(cause) > 0).cast("long")).alias("d")), "times")
    bounds = range_bounds(times, "t")
    times = running(times, "t", {"n": ("sum", F.col("m"))}, descending=True, bounds=bounds).withColumn("f", 1 - F.col("d") / F.col("n"))
    times = running(times, "t", {"lowest": ("min", F.col("f")), "logs": ("sum", F.when(F.col("f") > 0, F.ln("f")))}, strict=True, bounds=bounds)
    left = F.when(F.coalesce("lowest", F.lit(1.0)) > 0, F.exp(F.coalesce("logs", F.lit(0.0)))).otherwise(0.0)
    causes = df.filter(F.col(cause) > 0).groupBy(F.col(time).alias("t"), F.col(cause).alias("cause")).agg(F.count("*").alias("k"))
    steps = causes.join(times.select("t", "n", left.alias("s")), "t")
    return running(steps, "t", {"incidence": ("sum", F.col("s") * F.col("k") / F.col("n"))}, by="cause", bounds=bounds).select(F.col("t").alias("time"), "cause", "incidence")


def landmark(df: DataFrame, time: str, at: float) -> DataFrame:
    """Those still followed at the landmark, counted from there."""
    return df.filter(F.col(time) > at).withColumn(time, F.col(time) - at)


def crosstab_statistic(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's chi-square and its degrees of freedom, from one row for each cell."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    # sum (n - e)^2 / e = N (sum n^2 / (ra cb) - 1); empty cells add nothing to the sum.
    parts = cells.join(rows, "a").join(columns, "b").agg(F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb"))).alias("q"), F.sum("n").alias("total"), F.countDistinct("a").alias("k"), F.countDistinct("b").alias("l"))
    return parts.select((F.col("total") * (F.col("q") - 1)).alias("chi_square"), ((F.col("k") - 1) * (F.col("l") - 1)).alias("degrees"))


def mann_whitney(df: DataFrame, value: str, first_group: Column) -> DataFrame:
    """U of the first group by mid-ranks, over one row for each distinct value."""
    ties = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.when(first_group, 1)).alias("k"), F.count("*").alias("m"))
    ties = written(ties, "ties")
    ranked = running(ties, "v", {"below": ("sum", F.col("m"))}, strict=True).withColumn("mid", F.coalesce("below", F.lit(0)) + (F.col("m") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("k") * F.col("mid")).alias("r"), F.sum("k").alias("n1"), F.sum("m").alias("n"))
    return sums.select((F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), F.col("n1"), (F.col("n") - F.col("n1")).alias("n2"))


def mann_whitney_z(df: DataFrame, value: str, first_group: Column) -> DataFrame:
    """(u, n1, n2, z): U with its normal deviate, spread corrected for ties, moved half a step towards the mean; null without a spread."""
    known = df.filter(F.col(value).isNotNull())
    ties = known.groupBy(value).agg(F.count("*").cast("double").alias("_m")).agg(F.sum(F.pow("_m", F.lit(3.0)) - F.col("_m")).alias("ties")).first()[0] or 0.0
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.lit(ties) / (n * (n - 1))))
    apart = F.col("u") - n1 * n2 / 2
    moved = F.signum(apart) * F.greatest(F.abs(apart) - 0.5, F.lit(0.0))
    return mann_whitney(df, value, first_group).select("u", "n1", "n2", F.when((n > 1) & (spread > 0), moved / spread).alias("z"))


def odds_ratio(df: DataFrame, exposed: Column, outcome: Column) -> DataFrame:
    """Odds ratio of a two-by-two table with its 95 % interval."""
    of = lambda e, o: F.count(F.when((exposed if e else ~exposed) & (outcome if o else ~outcome), 1)).cast("double")
    t = df.agg(of(1, 1).alias("a"), of(1, 0).alias("b"), of(0, 1).alias("c"), of(0, 0).alias("d"))
    log_or = F.ln(F.col("a") * F.col("d") / (F.col("b") * F.col("c")))
    error = F.sqrt(1 / F.col("a") + 1 / F.col("b") + 1 / F.col("c") + 1 / F.col("d"))
    return t.select("a", "b", "c", "d", F.exp(log_or).alias("odds_ratio"), F.exp(log_or - 1.96 * error).alias("lower"), F.exp(log_or + 1.96 * error).alias("upper"))


def inverse_weights(df: DataFrame, treated: Column, score: Column, low: float = 0.01) -> DataFrame:
    """``df`` with weight and stabilized weight from a propensity score kept off 0 and 1."""
    p = F.greatest(F.least(score, F.lit(1 - low)), F.lit(low))
    share = df.agg(F.avg(treated.cast("double"))).first()[0]
    return df.withColumn("weight", F.when(treated, 1 / p).otherwise(1 / (1 - p))).withColumn("stabilized", F.when(treated, share / p).otherwise((1 - share) / (1 - p)))


def adjusted_p(df: DataFrame, p: str, name: str = "adjusted") -> DataFrame:
    """Benjamini-Hochberg: p * n / rank, made monotone from the largest p down; equal p share the last of their ranks.

    Aggregates run over one row for each distinct p, dealt by ranges of p.
    """
    counts = written(df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_m")), "p")
    n = counts.agg(F.sum("_m")).first()[0] or 0
    bounds = range_bounds(counts, "_p")
    raw = running(counts, "_p", {"_rank": ("sum", F.col("_m"))}, bounds=bounds).withColumn("_raw", F.least(F.col("_p") * n / F.col("_rank"), F.lit(1.0)))
    adjusted = running(raw, "_p", {name: ("min", F.col("_raw"))}, descending=True, bounds=bounds).select("_p", name)
    return df.join(adjusted, F.col(p) == F.col("_p"), "left").drop("_p")


def deviation_of_dimensions(df: DataFrame, vector: str, top: int) -> DataFrame:
    """Median absolute deviation of each vector component, the largest first."""
    spark = df.sparkSession
    long = df.select(F.posexplode(vector).alias("dimension", "x")).select("dimension", F.col("x").cast("double").alias("x"))
    centers = spark.createDataFrame([(k, m) for k, (m,) in quantiles(long, "dimension", "x", [0.5]).items()], "dimension int, m double")
    apart = long.join(F.broadcast(centers), "dimension").select("dimension", F.abs(F.col("x") - F.col("m")).alias("a"))  # a row a dimension
    spread = spark.createDataFrame([(k, m) for k, (m,) in quantiles(apart, "dimension", "a", [0.5]).items()], "dimension int, mad double")
    return spread.orderBy(F.desc("mad"), "dimension").limit(top)


def concordance(reported: Column, computed: Column) -> Column:
    """MATCH within 10 % of the reported value, MINOR within 20 %, else MAJOR."""
    gap = F.abs(computed - reported) / F.abs(reported)
    return F.when(gap <= 0.10, "MATCH").when(gap <= 0.20, "MINOR").otherwise("MAJOR")
