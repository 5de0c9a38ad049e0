"""Fixture rows and plain restatements used by the operator tests."""

import random
import re

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def docs(spark, rows):
    """(doc_id, text[, lang, source]) rows as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0",
             None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd_rows():
    """Null and empty texts, null ids, repeated rows, long and blank texts."""
    rng = random.Random(5)
    long_ = " ".join(word(rng) for _ in range(4000))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (6, long_), (7, long_ + " tail"),
            (None, "a text without an id, and more words than five"), (None, None), (8, "same text here in two rows"),
            (8, "same text here in two rows"), (9, "é ü ß 日本語 ünïcode wörds ñandú"), (10, "A" * 5000), (11, "x\n" * 300)]


def word(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))


def sentence(rng, n):
    return " ".join(word(rng) for _ in range(n))


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def clash(df):
    """The table with extra columns whose names an operator might use itself."""
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit(1) for c in ("key", "match", "node", "sig", "label", "shard", "part", "n", "gone", "before",
                                                  "component", "found", "item", "size", "u", "leaf_lang", "in_range", "at")})
