"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

The trees are trained on the URLs that a rule judges and see nothing but the URL's text: lengths, depth, shares
of digits, hyphens and capitals, entropy, parameter counts, and statistics of the host's suffix and of the path's first
segment. The statistics that a labelled URL is trained with leave out its own fold, so no label is read off itself. The fitted
trees become one SQL expression, so judging is a projection inside generated code. DataFrame functions only; the table is
read three times: for the statistics, for the drawn URLs (staged, equal ones as one row with a weight) and for the verdicts.

Defined cases: a null URL, or one without ``://``, has empty host and path, no rule, and the trees' verdict for
its (empty) features; if no URL is judged by a rule, or all alike, the verdict of the others is ``allow`` or that
one verdict; repeated rows are judged alike; extra columns pass through; columns named like outputs or like
``FEATURES``, _slots, _says or _fold are replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import staged

#: (rule, verdict): host, then the start of the path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Rules become one expression; a longer list than this is refused.
MOST_RULES = 500
#: About so many labelled URLs are drawn, by hash, for a fit.
LABELLED_ROWS = 20_000
#: Host suffixes, and first segments of paths, are told apart by so many slots each.
SLOTS = 512
#: Statistics of a labelled URL are those of the other folds.
FOLDS = 5
#: A slot's share of blocked URLs is drawn to the mean as by so many more.
DRAWN_TO_MEAN = 5
TREES, DEPTH = 12, 4
FEATURES = tuple(
    f"_{name}"
    for name in "length host_length path_length depth labels digits hyphens capitals entropy parameters query_length fragment suffix_rows suffix_blocked segment_rows segment_blocked".split()
)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return pages.withColumn("host", F.translate(host, _UPPER, _UPPER.lower())).withColumn("path", F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def slots() -> Column:
    """Slots of the host's last label and of the path's first segment."""
    parts = (F.element_at(F.split("host", r"\."), -1), F.regexp_extract("path", "^/([^/]*)", 1))
    return F.array(*(F.pmod(F.xxhash64(part, F.lit(k)), F.lit(SLOTS)).cast("int") for k, part in enumerate(parts)))


def with_features(pages: DataFrame, *statistics: Column) -> DataFrame:
    """Lexical features of the URL as doubles. ``statistics``: share of rows and of blocked ones in its suffix's slot, then in its segment's."""
    url = F.coalesce("url", F.lit(""))
    length = F.length(url)
    some = F.greatest(length, F.lit(1))
    share = lambda pattern: F.regexp_count(url, F.lit(pattern)) / some
    chars = F.split(url, "")
    # -sum p log2 p over the distinct characters; each is counted by what its removal takes away.
    parts = F.transform(F.array_distinct(F.filter(chars, lambda c: c != "")), lambda c: (length - F.length(F.replace(url, c, F.lit("")))) / some)
    entropy = F.aggregate(parts, F.lit(0.0), lambda total, p: total - p * F.log2(p))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    values = (
        length, F.length("host"), F.length("path"), F.regexp_count("path", F.lit("/")), F.size(F.split("host", r"\.")), share("[0-9]"), share("-"), share("[A-Z]"), entropy,
        F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1), F.length(query), url.contains("#").cast("int"), *statistics,
    )
    return pages.withColumns({name: value.cast("double") for name, value in zip(FEATURES, values, strict=True)})


def tree_expression(node) -> Column:
    """A fitted regression tree as nested conditions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(FEATURES[split.featureIndex()]) <= float(split.threshold()), tree_expression(node.leftChild())).otherwise(tree_expression(node.rightChild()))


def assembled(rows: DataFrame) -> DataFrame:
    """``rows`` with x, the vector of their features."""
    return VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)


def fitted(rows: DataFrame):
    """Boosted trees on rows of x, label and n, the weight."""
    return GBTClassifier(featuresCol="x", labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(rows.select("x", "label", "n"))


def tree_score(model) -> Column:
    """The probability that fitted trees give the label 1, over the columns ``FEATURES``."""
    margin = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights):
        margin = margin + F.lit(float(weight)) * tree_expression(tree._call_java("rootNode"))
    return 1 / (1 + F.exp(-2 * margin))


def judge(pages: DataFrame, rules=RULES, labelled_rows: int = LABELLED_ROWS, teaches: Column | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict, and block_score (0 to 1, from the trees alone).

    ``teaches``: of the rows that a rule judges, those that may teach the trees (default: all).
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "block_score", "_slots", "_says", "_fold", *FEATURES)]
    name, says = rule_columns(rules)
    parsed = with_host_and_path(pages.select(*(F.col(f"`{c}`") for c in kept))).withColumn("rule", name).withColumn("_says", says).withColumn("_slots", slots())
    fold = F.pmod(F.xxhash64("url", F.lit(3)), F.lit(FOLDS)).cast("int")
    labelled = parsed.withColumn("_fold", fold).filter(F.col("_says").isNotNull() & (F.lit(True) if teaches is None else teaches))
    # 2 x SLOTS x FOLDS rows at most, whatever the number of suffixes and segments.
    each = labelled.select(F.posexplode("_slots").alias("kind", "slot"), "_fold", (F.col("_says") == "block").cast("int").alias("blocked"))
    seen = {(r["kind"], r["slot"], r["_fold"]): (r["n"], r["blocked"]) for r in each.groupBy("kind", "slot", "_fold").agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked")).collect()}
    total, blocked = (sum(x[k] for (kind, *_), x in seen.items() if kind == 0) for k in (0, 1))
    if not 0 < blocked < total:
        score = F.lit(1.0 if blocked else 0.0)
        judged = parsed
    else:
        mean = blocked / total
        shares = lambda n, b: (n / total, (b + DRAWN_TO_MEAN * mean) / (n + DRAWN_TO_MEAN))
        sums = {key: tuple(sum(seen.get((*key, f), (0, 0))[k] for f in range(FOLDS)) for k in (0, 1)) for key in {(kind, slot) for kind, slot, _ in seen}}
        by_slot = {key: shares(*x) for key, x in sums.items()}
        column = lambda kind, k: F.array(*(F.lit(by_slot.get((kind, i), (0.0, mean))[k]) for i in range(SLOTS)))
        judged = with_features(parsed, *(F.get(column(kind, k), F.get("_slots", F.lit(kind))) for kind in (0, 1) for k in (0, 1)))
        others = [(*key, f, *shares(*(sums[key][k] - seen.get((*key, f), (0, 0))[k] for k in (0, 1)))) for key in sums for f in range(FOLDS)]
        without = [
            pages.sparkSession.createDataFrame([x[1:] for x in others if x[0] == kind], f"slot{kind} int, _fold int, rows{kind} double, blocked{kind} double") for kind in (0, 1)
        ]
        share = min(1.0, labelled_rows / total)
        drawn = labelled.filter(F.pmod(F.xxhash64("url", F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)
        distinct = drawn.groupBy("url", "host", "path", "_slots", "_fold", (F.col("_says") == "block").cast("double").alias("label")).agg(F.count("*").cast("double").alias("n"))
        for kind in (0, 1):
            distinct = distinct.withColumn(f"slot{kind}", F.get("_slots", F.lit(kind))).join(F.broadcast(without[kind]), [f"slot{kind}", "_fold"])
        rows = with_features(distinct, F.col("rows0"), F.col("blocked0"), F.col("rows1"), F.col("blocked1"))
        rows = staged(rows.select(*FEATURES, "label", "n"), "urls")
        score = tree_score(fitted(assembled(rows)))
    scored = judged.withColumn("block_score", score)
    verdict = F.coalesce("_says", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).select(*(F.col(f"`{c}`") for c in kept), "host", "path", "rule", "verdict", "block_score")
