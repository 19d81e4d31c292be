"""Small tables with what the operators must stand: nulls, ties, repeats, long texts, clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as columns of the user's table.
CLASHING = ["size", "shard", "slot", "row", "id", "doc", "tie", "spans", "changed", "cut", "copies", "taken", "print",
            "score", "features", "margin", "f", "toxic", "deal", "component", "node", "words", "p", "weight", "n"]


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def documents(spark, texts, source="a", first=0):
    rows = [(first + i, t, "en", source, len(t or "")) for i, t in enumerate(texts)]
    return table(spark, rows)


def prose(n, seed=0, vocabulary=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def awkward(spark):
    """Null, empty and blank texts, null ids and sources, a repeated row, a repeated id, a very long text."""
    same = prose(60, 3)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (None, prose(40, 1), "en", "a", 1),
            (None, None, "en", None, 1), (4, same, "en", "b", 9), (4, same, "en", "b", 9), (4, prose(50, 5), "en", "b", 9),
            (5, same, "de", "c", 9), (6, prose(300_000, 7), "fr", "c", 9), (7, "x", "en", "b", 1), (8, "é ï 日本", "en", "b", 1)]
    return table(spark, rows)


def clashing(df):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit(f"my {c}") for c in CLASHING})
