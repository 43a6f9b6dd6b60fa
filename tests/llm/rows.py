"""Hand-made tables with the cases every operator must take."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("key", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("_deleted", T.StringType()),
        T.StructField("size", T.StringType()),
    ]
)


def documents(spark, texts):
    """(doc_id, text) pairs as a table of documents with other columns, some null."""
    rows = [(i, t, None if n % 3 else "en", None, len(t or ""), "x", None, "y", "z") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
MESSY = [
    (1, "First line here\nsecond line there\nthird line\n"),
    (2, "First line here\nsecond line there\nanother\n\n  \n"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, LONG),
    (7, LONG),
    (None, "First line here\nsecond line there\nthird line\n"),
    (None, None),
    (9, "ß É 漢字 🙂 ▁x  y"),
    (9, "ß É 漢字 🙂 ▁x  y"),
    (9, "other text of the same id"),
    (10, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a"),
]


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
