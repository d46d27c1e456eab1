"""Small tables that every operator has to stand: nulls, empty and long texts, ties, repeats, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))


def odd_rows():
    return [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, None, 4),
        (4, "one", "en", "b", 3),
        (5, LONG, "en", "b", len(LONG)),
        (6, LONG, "en", "b", len(LONG)),
        (7, "same same same same same same same same same same same same same same same same same same same same same same", "en", "c", 1),
        (8, "émoji 😀 straße ÀÉ \x00 nul", "fr", "c", 1),
        (9, "one", "de", "c", 3),
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The same rows with columns named as the operators' inner ones."""
    from pyspark.sql import functions as F

    names = ["words", "p", "h", "block", "bucket", "spans", "text_key", "hit_id", "n_words", "batch", "score", "turns", "component_id"]
    return df.select("*", *[F.lit("x").alias(c) for c in names])
