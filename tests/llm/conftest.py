import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents of every odd kind: nulls anywhere, empty and very long texts, repeated rows and ids, clashing names of columns."""
    long = "word " * 40_000 + "a.b@c.de"
    rows = [
        (1, "plain text with a few words in it", "en", "s1"), (2, None, "en", None), (3, "", None, "s1"), (None, "no id here", "en", "s2"), (None, None, None, None), (5, long, "en", "s1"), (6, "plain text with a few words in it", "en", "s2"),
        (6, "plain text with a few words in it", "en", "s2"), (7, " \t\n ", "fr", "s1"), (8, "é\U0001f600 mail x@y.org +1 (555) 123-4567 " + "7" * 9000, "de", "s3"), (9, "=" * 5000 + "\u0000end", "en", "s1"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["n_chars", "_row", "_kept", "_block", "_text", "_end", "kind", "start", "end", "base", "found", "node", "band", "comp", "place", "size", "row", "w", "u", "c", "own", "label", "shared", "stat_words", "id", "key", "h"]
    return df.select("*", *[F.lit(1).cast("long").alias(n) for n in names])
