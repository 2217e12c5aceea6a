"""Codes: tiered resolution, site and histology, edits."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessella.functions.values import mixed_date
from tessella.session import written

# Registry sites and histology ranges.
PAIRED_SITES = ("C50", "C34", "C64", "C69", "C62", "C56", "C74", "C07", "C09", "C30", "C44", "C47", "C49", "C70", "C71", "C72", "C40", "C41")
MALE_SITES = ("C61", "C62", "C63")
FEMALE_SITES = ("C53", "C54", "C55", "C56", "C57", "C58")
HISTOLOGY_RANGES = {"melanoma": (8720, 8790), "myeloma": (9731, 9734), "lymphoma": (9590, 9729), "leukemia": (9800, 9948)}
#: First characters of ICD-10-CM codes by chapter.
CHAPTERS = (
    ("neoplasm", ("C", "D0", "D1", "D2", "D3", "D4")), ("blood", ("D5", "D6", "D7", "D8")), ("endocrine", ("E",)), ("circulatory", ("I",)), ("respiratory", ("J",)),
    ("digestive", ("K",)), ("genitourinary", ("N",)), ("symptom", ("R",)), ("injury", ("T",)), ("encounter", ("Z",)),
)
CONFIDENCE = {"code": 1.0, "code in other case": 0.95, "description": 0.9}
FUZZY_CUTOFF = 85.0


def chapter(code: Column) -> Column:
    out = F.lit("other")
    for name, starts in reversed(CHAPTERS):
        hit = F.lit(False)
        for s in starts:
            hit = hit | code.startswith(s)
        out = F.when(hit, name).otherwise(out)
    return out


def dotted(code: Column) -> Column:
    """A dot after the third character of a longer code."""
    return F.when(F.length(code) > 3, F.concat(F.substring(code, 1, 3), F.lit("."), F.substr(code, F.lit(4)))).otherwise(code)


def resolved(values: DataFrame, table: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """``values`` with resolved_code and resolution_confidence from a table (keys, code, description).

    Exact code, then code in any case, then description in any case. One candidate list, one join: each code offers three
    keys, and the tier with the highest confidence wins, the smaller code among equals. Empty values resolve to nothing.
    """
    offers = (
        table.select(*keys, F.col("code").alias("_code"), F.lit(CONFIDENCE["code"]).alias("_sure"), F.col("code").alias("_at"))
        .unionByName(table.select(*keys, F.col("code").alias("_code"), F.lit(CONFIDENCE["code in other case"]).alias("_sure"), F.concat(F.lit("c:"), F.lower("code")).alias("_at")))
        .unionByName(table.select(*keys, F.col("code").alias("_code"), F.lit(CONFIDENCE["description"]).alias("_sure"), F.concat(F.lit("d:"), F.lower("description")).alias("_at")))
    )
    best = offers.groupBy(*keys, "_at").agg(F.max("_sure").alias("_sure"), F.min("_code").alias("_code"))
    # Each distinct value is resolved once, by one join of its three keys; empty values take part in no join.
    v = F.trim(F.col(value))
    asked = values.select(*keys, v.alias("_v")).filter("_v <> ''").distinct()
    ways = F.explode(F.array(F.col("_v"), F.concat(F.lit("c:"), F.lower("_v")), F.concat(F.lit("d:"), F.lower("_v")))).alias("_at")
    found = asked.select(*keys, "_v", ways).join(best, [*keys, "_at"]).groupBy(*keys, "_v").agg(F.max_by("_code", "_sure").alias("_code"), F.max("_sure").alias("_sure"))
    # A random text that stands in for empty ones deals them evenly and meets nothing.
    nothing = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
    out = values.withColumn("_v", F.when(v != "", v).otherwise(nothing)).join(found, [*keys, "_v"], "left")
    return out.withColumn("resolved_code", F.col("_code")).withColumn("resolution_confidence", F.coalesce("_sure", F.lit(0.0))).select(*values.columns, "resolved_code", "resolution_confidence")


def expanded(query: Column) -> Column:
    """Everyday words with the formal ones beside them."""
    return F.regexp_replace(query, r"(?<!\S)(cancers?)(?!\S)", "$1 malignant neoplasm carcinoma tumor")


# Words that stand in very many descriptions and tell nothing.
BOILERPLATE = (
    "the", "of", "in", "and", "or", "with", "by", "to", "for", "malignant", "neoplasm", "unspecified", "disease", "disorder", "value", "volume", "mass", "type", "other", "not",
    "elsewhere", "classified", "nos", "finding", "procedure", "qualifier", "tumor", "tumour", "carcinoma",
)


def partial_ratio(a: str, b: str) -> float:
    """0 to 1: how like the shorter text is to the part of the longer that it fits best."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    if short in long:
        return 1.0
    starts = {max(0, m.b - m.a) for m in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks()}
    return max(SequenceMatcher(None, short, long[s : s + len(short)], autojunk=False).ratio() for s in starts)


def similarity(a: str, b: str) -> float:
    """0 to 100: the better of partial and token-set likeness; no shared word beside boilerplate costs two fifths."""
    a, b = a.lower(), b.lower()
    x, y = set(a.split()), set(b.split())
    shared = " ".join(sorted(x & y))
    left, right = " ".join([shared, *sorted(x - y)]).strip(), " ".join([shared, *sorted(y - x)]).strip()
    tokens = max((SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in ((shared, left), (shared, right), (left, right)) if p and q), default=0.0)
    told, known = x - set(BOILERPLATE), y - set(BOILERPLATE)
    return 100 * max(partial_ratio(a, b), tokens) * (0.6 if told and known and not told & known else 1.0)


#: Rows of one key on the left that one task gets, about, and frequent keys that are broadcast, at most.
SPLIT, FREQUENT = 20_000, 10_000
#: Substrings of the texts looked for that are broadcast, at most, and letters in them and their texts; more are joined by shuffle.
LOOKED_FOR, LETTERS = 100_000, 4_000_000
#: Texts that a task cuts into pieces, about.
TEXTS = 50_000
#: Share of the longer text that must be left; below it pieces become so short that they tell nothing.
LEAST_ALIKE = 2 / 3
#: Texts this like a description are compared with it though they share no word.
SPELT_ALIKE = 70.0


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, split: int | None = None) -> DataFrame:
    """An inner join by ``key`` in which a frequent key is split: its left rows are dealt by ``spread``, its right rows repeated.

    A key with n rows on the left has one part for every ``split`` of them, so no common word or piece fills a task. Nothing is
    broadcast by Spark's estimate, which knows the size of a table but not that of the rows made of it; frequent keys are, by their count.
    """
    split = split or SPLIT
    often = written(left.groupBy(key).agg(F.ceil(F.count("*") / split).cast("int").alias("_parts")).filter("_parts > 1"), "frequent")
    often = F.broadcast(often) if often.count() <= FREQUENT else often.hint("merge")
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(often, key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    repeated = right.join(often, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(repeated.hint("merge"), [key, "_part"]).drop("_part")


def edits(longer: Column, c: float) -> Column:
    """How many edits two texts may be apart, if the longer has so many letters."""
    return F.floor((1 - c) * longer + 1e-6).cast("int")


def longest(n: Column, c: float) -> Column:
    return F.floor((n + 1e-6) / c).cast("int")


def pieces(df: DataFrame, t: str, c: float) -> DataFrame:
    """(t, n, g, place, at): each text cut into one piece more than the edits that a text as long at most may be apart, and again for those of longer ones.

    ``g`` is the piece after a mark of its cut, ``place`` its number, ``at`` where it starts; all count from 0.
    """

    def cut(mark: str, m: Column) -> Column:
        start = lambda i: F.floor(i * F.col("n") / m).cast("int")
        piece = lambda i: F.concat(F.lit(mark), F.substr(t, start(i) + 1, start(i + 1) - start(i)))
        return F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(piece(i).alias("g"), i.alias("place"), start(i).alias("at")))

    rows = df.select(t, F.length(t).alias("n")).select(t, "n", (edits(F.col("n"), c) + 1).alias("m"), (edits(longest(F.col("n"), c), c) + 1).alias("more"))
    every = F.when(F.col("more") > F.col("m"), F.concat(cut("=", F.col("m")), cut(">", F.col("more")))).otherwise(cut("=", F.col("m")))
    return rows.select(t, "n", F.inline(every))


def substrings(df: DataFrame, t: str, c: float) -> DataFrame:
    """(t, size, g, start): of each text all substrings as long as a piece of a text that may be like it, by the cuts of ``pieces``."""
    size = F.col("size")
    lengths = lambda n, m: F.array(F.floor(n / m).cast("int"), F.ceil(n / m).cast("int"))
    # Lengths that a text like this one may have, by the cut that such a pair is found by.
    others = F.sequence(F.ceil(size * c - 1e-6).cast("int"), longest(size, c))
    same = F.filter(others, lambda n: edits(F.greatest(n, size), c) == edits(n, c))
    more = F.filter(others, lambda n: edits(F.greatest(n, size), c) > edits(n, c))
    by_cut = F.array(
        F.struct(F.lit("=").alias("mark"), F.array_distinct(F.flatten(F.transform(same, lambda n: lengths(n, edits(n, c) + 1)))).alias("ks")),
        F.struct(F.lit(">").alias("mark"), F.array_distinct(F.flatten(F.transform(more, lambda n: lengths(n, edits(longest(n, c), c) + 1)))).alias("ks")),
    )
    rows = df.select(t, F.length(t).alias("size")).select(t, "size", F.inline(by_cut)).select(t, "size", "mark", F.explode("ks").alias("k")).filter("k <= size")
    return rows.select(t, "size", "mark", "k", F.explode(F.sequence(F.lit(0), size - F.col("k"))).alias("start")).select(
        t, "size", "start", F.concat("mark", F.substr(t, F.col("start") + 1, F.col("k"))).alias("g")
    )


def alike(values: DataFrame, table: DataFrame, value: str, other: str, cutoff: float = 75.0) -> DataFrame:
    """(value, other, score): all pairs of distinct texts whose edit distance leaves ``cutoff`` percent of the longer one, or more.

    Complete, without comparing all pairs: a text is cut into more pieces than there may be edits, so one piece stands unchanged in
    any text that close. Of the pieces that do, one has exactly as many edits before it as pieces, and what is left of them behind it, which
    bounds where it may have moved to. Pieces and substrings of a length meet by an index, and the rest is settled by the edit distance itself.
    Few substrings are broadcast, by their count; more are joined by shuffle. The cut-off must lie above two thirds, below which pieces
    are single letters. Null and empty texts are like nothing.
    """
    c = cutoff / 100
    if not LEAST_ALIKE < c <= 1:
        raise ValueError(f"the cut-off lies above {100 * LEAST_ALIKE:.0f} and is 100 at most")
    left = written(values.select(F.col(value).alias("a")).filter("a <> ''").distinct(), "values")
    right = written(table.select(F.col(other).alias("b")).filter("b <> ''").distinct(), "others")
    (_, left_size), (_, right_size) = sides = [df.select(F.count("*"), F.coalesce(F.sum(F.length(t)), F.lit(0))).first() for df, t in ((left, "a"), (right, "b"))]
    # A text has fewer pieces than substrings, so the larger side is cut.
    swapped = right_size > left_size
    (whole, t), (known, u) = ((right, "b"), (left, "a")) if swapped else ((left, "a"), (right, "b"))
    cut = pieces(whole.repartition(max(1, -(-sides[swapped][0] // TEXTS)), t), t, c)
    sought = substrings(known, u, c)
    size = sides[not swapped][0] <= LOOKED_FOR and sought.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(u) + F.length("g")), F.lit(0)).alias("letters")).first()
    met = cut.join(F.broadcast(sought), "g") if size and size["n"] <= LOOKED_FOR and size["letters"] <= LETTERS else salted_join(cut, sought, "g", t)
    most, moved = edits(F.greatest("n", "size"), c), F.col("start") - F.col("at")
    placed = (F.abs(moved) <= F.col("place")) & (F.abs(moved - (F.col("size") - F.col("n"))) <= most - F.col("place"))
    right_cut = F.col("g").startswith("=") == (most == edits(F.col("n"), c))
    score = 100 * (1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b")))
    # One condition, so the distance is worked out last; conditions of their own would be put in front.
    close = met.withColumn("most", most).filter(placed & right_cut & F.expr("levenshtein(a, b, most) >= 0") & (score >= cutoff - 1e-9))
    return close.select("a", "b").distinct().select(F.col("a").alias(value), F.col("b").alias(other), score.alias("score"))


@F.pandas_udf(DoubleType())
def fuzzy_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or q is None else similarity(p, q) for p, q in zip(a, b)], dtype=float)


def fuzzy_top(values: DataFrame, table: DataFrame, value: str, limit: int = 5, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """(value, code, score): best codes for each distinct value among descriptions that share a telling word with it, or are spelt alike.

    Boilerplate doesn't bring two texts together, unless a text holds nothing else. Misspelt texts that share no word are
    found by their pieces, completely from ``SPELT_ALIKE`` percent on.
    """

    def words(text: str):
        every = F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))
        telling = F.array_except(every, F.array(*map(F.lit, BOILERPLATE)))
        return F.explode(F.when(F.size(telling) > 0, telling).otherwise(every)).alias("_t")

    left = values.select(value).filter(F.col(value).isNotNull()).distinct()
    right = table.select("code", "description").filter(F.col("description").isNotNull()).distinct()
    sharing = salted_join(left.select(value, words(value)), right.select("description", words("description")).distinct(), "_t", value).select(value, "description")
    low = lambda df, c, name: df.select(c, F.lower(c).alias(name))
    spelt = alike(low(left, value, "_low"), low(right, "description", "_known"), "_low", "_known", SPELT_ALIKE).drop("score")
    spelt = low(left, value, "_low").join(spelt, "_low").join(low(right, "description", "_known").distinct(), "_known").select(value, "description")
    pairs = sharing.unionByName(spelt).distinct().withColumn("score", fuzzy_score(value, "description")).join(right, "description")
    best = pairs.filter(F.col("score") >= cutoff).groupBy(value, "code").agg(F.max("score").alias("score"))
    rank = Window.partitionBy(value).orderBy(F.desc("score"), "code")
    return best.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= limit).select(value, "code", "score")


def schema_of(site: Column, histology: Column, schemas: dict[str, str]) -> Column:
    """Staging schema by the site's first three characters, else by the histology's range."""
    prefix = F.regexp_extract(F.upper(F.trim(site)), r"^(C\d{2})", 1)
    number = F.substring_index(F.trim(histology), "/", 1).try_cast("int")
    within = lambda name: number.between(*HISTOLOGY_RANGES[name])
    by_histology = F.when(within("myeloma"), "myeloma").when(within("lymphoma"), "lymphoma").when(within("leukemia"), "leukemia").otherwise("generic")
    out = by_histology
    for code, schema in schemas.items():
        own = F.when(within("melanoma"), schema).otherwise("generic") if code == "C44" else F.lit(schema)
        out = F.when(prefix == code, own).otherwise(out)
    return out


def site_valid(code: Column) -> Column:
    """C and two or three digits; one dot before the last is accepted."""
    return F.upper(F.trim(code)).rlike(r"^C\d{2}(?:\.?\d)?$")


def histology_valid(code: Column) -> Column:
    return F.coalesce(F.substring(F.trim(code), 1, 4).try_cast("int").between(8000, 9989), F.lit(False))


def validation(valid: Column, confidence: Column) -> Column:
    """valid, corrected, warning or invalid."""
    return F.when(valid, "valid").when(confidence >= 0.8, "corrected").when(confidence > 0, "warning").otherwise("invalid")


def sex_edit(site: Column, sex: Column) -> Column:
    """Sites that only one sex has: 1 male, 2 female."""
    prefix = F.substring(F.upper(F.trim(site)), 1, 3)
    return F.when(prefix.isin(*MALE_SITES) & (sex != "1"), "male site").when(prefix.isin(*FEMALE_SITES) & (sex != "2"), "female site")


def laterality_edit(site: Column, laterality: Column) -> Column:
    prefix = F.substring(F.upper(F.trim(site)), 1, 3)
    return F.when(prefix.isin(*PAIRED_SITES) & F.coalesce(laterality, F.lit("")).isin("", "0", "9"), "paired site without side")


def treatment_edit(diagnosed: Column, treated: Column) -> Column:
    """Treatment dates before the date of diagnosis, both in any registry format."""
    return F.coalesce(mixed_date(treated) < mixed_date(diagnosed), F.lit(False))


def retrieved(keywords: DataFrame, vocabulary: DataFrame, key: str, word: str, a_word: int = 5, in_all: int = 25) -> DataFrame:
    """(key, code, description, score): at most ``a_word`` codes for each keyword, each code once, at most ``in_all`` a key."""
    top = fuzzy_top(keywords, vocabulary, word, a_word)
    hits = keywords.join(top, word).groupBy(key, "code").agg(F.max("score").alias("score"))
    rank = Window.partitionBy(key).orderBy(F.desc("score"), "code")
    kept = hits.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= in_all).drop("_n")
    return kept.join(vocabulary.groupBy("code").agg(F.min("description").alias("description")), "code").select(key, "code", "description", "score")


#: Keywords of one automaton, and their characters, at most; more keywords take more passes over the texts.
AUTOMATON, AUTOMATON_TEXT = 100_000, 2_000_000


def _finder(shared):
    """A UDF for the broadcast keywords that stand in a text."""

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for k in shared.value:
            automaton.add_word(k, k)
        automaton.make_automaton()
        for batch in batches:
            yield pd.Series([sorted({k for _, k in automaton.iter(t)}) if t and shared.value else [] for t in batch], dtype=object)

    return F.pandas_udf(found, "array<string>").asNondeterministic()


def containing(texts: DataFrame, keywords: DataFrame, text: str, keyword: str) -> DataFrame:
    """``texts`` with ``keyword``, one row for each distinct keyword that stands anywhere in the text.

    Keywords become automata (a trie with failure links) of a bounded size, which are broadcast; each finds all of its keywords
    in one pass over a text, however many there are. Null texts, and null or empty keywords, meet nothing.
    """
    known = written(keywords.select(F.col(keyword).alias("k")).filter("k <> ''").distinct(), "keywords")
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.length("k")), F.lit(0))).first()
    blocks = max(1, -(-n // AUTOMATON), -(-size // AUTOMATON_TEXT))
    out = None
    for block in range(blocks):
        own = [r["k"] for r in known.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block).collect()]
        hit = _finder(texts.sparkSession.sparkContext.broadcast(own))
        rows = texts.withColumn("_hits", hit(text)).withColumn(keyword, F.explode("_hits")).drop("_hits")
        out = rows if out is None else out.unionByName(rows)
    return out


def topography(diagnoses: DataFrame, groups: DataFrame, table: DataFrame, key: str, normal: str, generic: list[tuple[str, str]], cutoff: float = 60.0) -> DataFrame:
    """(key, code, how) for normalised diagnoses: keyword groups, else fuzzy descriptions, else the generic codes.

    ``groups``: (keyword, code), any number; the keywords are found by automata.
    """
    standing = containing(diagnoses, groups, normal, "keyword").select(key, "keyword")
    by_word = standing.join(groups, "keyword").select(key, "code").distinct().withColumn("how", F.lit("keyword"))
    open_ = diagnoses.join(by_word.select(key).distinct(), key, "left_anti")
    fuzzy = open_.join(fuzzy_top(open_, table, normal, 5, cutoff), normal).select(key, "code").distinct().withColumn("how", F.lit("fuzzy"))
    rest = open_.join(fuzzy.select(key).distinct(), key, "left_anti")
    rest = rest.select(key, F.explode(F.array(*(F.lit(c) for c, _ in generic))).alias("code")).withColumn("how", F.lit("generic"))
    return by_word.unionByName(fuzzy).unionByName(rest)


def audit_trail(results: DataFrame) -> DataFrame:
    """Where each value came from; evidence is cut at 500 characters."""
    keep = [c for c in ("patient_id", "field", "value", "resolved_code", "confidence", "source_chunk_id", "pass", "ontology_id") if c in results.columns]
    return results.select(*keep, F.substring(F.coalesce("evidence", F.lit("")), 1, 500).alias("evidence"))
