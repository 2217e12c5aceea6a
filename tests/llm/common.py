"""Documents with everything that may go wrong in them."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The quick brown fox jumps over the lazy dog near the river. It was a bright cold day in April, and the clocks were striking thirteen. "
GERMAN = "Der schnelle braune Fuchs springt über den faulen Hund. Es war ein kalter Tag im April, und die Uhren schlugen dreizehn. "


def odd_documents(spark, clashing=()):
    rows = [
        (1, PROSE * 3, "en", "a"), (2, PROSE * 3, "en", "a"), (3, None, None, "a"), (4, "", "en", None), (5, " \n\t ", "en", "b"), (6, GERMAN * 2, "de", "b"), (7, "word", None, "b"),
        (8, "long " * 60_000, "en", "c"), (9, "!!! ### 12345", "en", "c"), (None, PROSE, "en", "c"), (None, None, None, None), (10, GERMAN, "de", "c"), (10, GERMAN, "de", "c"), (11, "ä😀é " * 40, "de", "c"),
    ]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)
    for name in clashing:
        df = df.selectExpr("*", f"'kept' AS `{name}`")
    return df


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
