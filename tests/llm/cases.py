"""Rows that every operator on documents has to survive."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LONG = " ".join(f"word{i % 977} and" for i in range(30_000))

HARD = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
    (2, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
    (2, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
    (3, "", "en", None, 0),
    (4, None, None, "a", None),
    (None, "no id here", "fr", "b", 10),
    (5, LONG, "en", "b", len(LONG)),
    (6, "naïve ßtraße İstanbul’s 你好 　 x́ don't 'S'LL!! \t\n 12 34", "de", "b", 50),
    (7, "   \n\n ", "es", "b", 6),
    (-8, "tail", "es", "b", 4),
]


def frame(spark, rows=HARD):
    return spark.createDataFrame(rows, DOCS)


def crowded(df):
    """The same rows with more columns, whose names are ones that operators use inside."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in ("id", "rank", "part", "slot", "base", "size", "bucket", "key", "words", "hash", "pos", "class", "row")])
