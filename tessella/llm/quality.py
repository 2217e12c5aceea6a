"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote patterns estimates the
share of good texts and how often each rule votes rightly on good and on bad texts; the posterior
probability of being good then replaces the demand that every rule pass.

Counts and votes of the whole text are computed once, by array functions inside each row, and written to the
shared folder; the number of vote patterns, at most 3 to the power of the rules, is all that reaches the driver.

Defined cases: a null or wordless text has zero counts, and abstains wherever a share would divide by zero;
without any row the estimates are the starting values; repeated rows are judged alike; extra columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import staged

SPACE = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
ROUNDS = 60
#: Where estimation starts: the share of good texts, and how often a rule votes bad, abstains and votes good on
#: bad and on good texts. This prior counts as much as a twentieth of the texts, which keeps the two kinds apart.
START_GOOD = 0.8
START_HABITS = ((0.25, 0.35, 0.4), (0.005, 0.095, 0.9))
PRIOR_WEIGHT = 0.05
KEPT_FROM = 0.5


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once in each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words of an array that stand in 3-word windows found twice or more, compared by 64-bit hashes."""
    none = F.lit(0).cast("long")

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda at, k: F.coalesce(F.least(F.get(starts, k + 1) - at, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, none, lambda total, gap: total + gap)

    def of_sorted(pairs: Column) -> Column:
        again = F.filter(
            pairs,
            lambda x, j: F.coalesce(F.get(pairs, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, j + 1)["h"] == x["h"], F.lit(False)),
        )
        return _bound(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

    def of_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(_bound(pairs, of_sorted))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(F.size(words) < 3, none).otherwise(_bound(windows, of_hashes))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules look at, of the whole text."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    long = lambda c: c.cast("long")
    of_words = _bound(
        words,
        lambda w: F.struct(
            long(F.size(w)).alias("n_words"),
            long(F.length(F.array_join(w, ""))).alias("word_chars"),
            long(F.size(F.array_distinct(w))).alias("n_distinct"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = _bound(
        lines,
        lambda x: F.struct(
            long(F.size(x)).alias("n_lines"),
            long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            long(F.size(F.filter(x, lambda line: line.rlike(rf"""[.!?…。！？]["'”’)\]]*[{SPACE}]*$""")))).alias("n_ended"),
        ),
    )
    return docs.select(
        "doc_id",
        of_words.alias("w"),
        of_lines.alias("l"),
        long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
        long(F.regexp_count(text, F.lit("!"))).alias("n_shouts"),
        long(F.regexp_count(text, F.lit(r"\p{Lu}"))).alias("n_upper"),
        long(F.regexp_count(text, F.lit(r"[\p{L}\p{M}]"))).alias("n_letters"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_shouts", "n_upper", "n_letters")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.nullif(F.col(whole), F.lit(0))


#: (rule, measured share, good up to, bad from); where good lies above bad, the share is better the higher it is.
RULES = (
    ("letters", lambda: _share("n_letters", "word_chars"), 0.9, 0.85),
    ("symbol density", lambda: _share("n_symbols", "word_chars"), 0.01, 0.05),
    ("symbols", lambda: _share("n_symbols", "n_words"), 0.02, 0.1),
    ("shouting", lambda: _share("n_shouts", "n_words"), 0.02, 0.1),
    ("capitals", lambda: _share("n_upper", "word_chars"), 0.12, 0.3),
    ("repeated windows", lambda: _share("n_repeat_words", "n_words"), 0.1, 0.3),
    ("repeated lines", lambda: _share("n_dup_lines", "n_lines"), 0.1, 0.3),
    ("ended lines", lambda: _share("n_ended", "n_lines"), 0.6, 0.2),
    ("distinct words", lambda: _share("n_distinct", "n_words"), 0.25, 0.1),
    ("word length", lambda: F.abs(_share("word_chars", "n_words") - 5.5), 1.5, 3.0),
    ("words", lambda: F.col("n_words").cast("double"), 40.0, 15.0),
)


def vote(share: Column, good: float, bad: float) -> Column:
    """1 good, -1 bad, 0 abstains (also where nothing can be measured)."""
    rising = good > bad
    is_good, is_bad = (share >= good, share <= bad) if rising else (share <= good, share >= bad)
    return F.when(is_good, 1).when(is_bad, -1).otherwise(0)


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[list[tuple[float, ...]]]]:
    """The share of good texts and, for bad and for good texts, how often each rule votes bad, abstains and votes good."""
    n = len(next(iter(patterns))) if patterns else len(RULES)
    total = sum(patterns.values())
    share, habits = START_GOOD, [[start] * n for start in START_HABITS]
    for _ in range(rounds if patterns else 0):
        soft = {p: posterior(p, share, habits) for p in patterns}
        share = min(0.99, max(0.01, sum(c * soft[p] for p, c in patterns.items()) / total))
        fresh = []
        for is_good, start in enumerate(START_HABITS):
            seen = [[x * PRIOR_WEIGHT * total for x in start] for _ in range(n)]
            for p, c in patterns.items():
                weight = c * (soft[p] if is_good else 1 - soft[p])
                for x, s in zip(p, seen):
                    s[x + 1] += weight
            fresh.append([tuple(x / sum(s) for x in s) for s in seen])
        habits = fresh
    return share, habits


def log_odds(share: float, habits: list[list[tuple[float, ...]]]) -> tuple[float, list[tuple[float, ...]]]:
    """Log odds of being good before any vote, and what each rule's vote (bad, none, good) adds."""
    return math.log(share / (1 - share)), [tuple(math.log(g / b) for b, g in zip(bad, good)) for bad, good in zip(*habits)]


def posterior(votes: tuple[int, ...], share: float, habits: list[list[tuple[float, ...]]]) -> float:
    odds, added = log_odds(share, habits)
    odds += sum(adds[x + 1] for x, adds in zip(votes, added))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, quality (posterior probability of being good) and whether it reaches ``KEPT_FROM``."""
    names = [f"v{i}" for i in range(len(RULES))]
    counted = counts(docs)
    votes = counted.select("*", *(vote(share(), good, bad).cast("tinyint").alias(v) for v, (_, share, good, bad) in zip(names, RULES)))
    held = staged(votes, "votes")
    patterns = {tuple(r[v] for v in names): r["n"] for r in held.groupBy(*names).agg(F.count("*").alias("n")).collect()}
    start, added = log_odds(*estimate(patterns))
    odds = F.lit(start)
    for v, (bad, none, good) in zip(names, added):
        odds = odds + F.when(F.col(v) < 0, bad).when(F.col(v) > 0, good).otherwise(none)
    quality = 1 / (1 + F.exp(-odds))
    return held.withColumn("quality", quality).withColumn("good", F.col("quality") >= KEPT_FROM).drop(*names)


def base_failed() -> Column:
    """Too few words, or over half of them repeated."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
