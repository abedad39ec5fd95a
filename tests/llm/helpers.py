"""Small document tables with awkward rows, and plain re-computations."""

import re
from collections import Counter
from math import log2

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def docs(spark, texts, sources=None):
    """One row per text; ids count from 0."""
    sources = sources or ["a"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, None) for i, (t, s) in enumerate(zip(texts, sources))], DOCS)


def clashing(df):
    """Extra columns named like those that operators make."""
    extra = ("words", "_words", "score", "label", "fp", "key", "size", "taken", "start", "n_hit", "root", "_pos", "shard", "kind")
    for name in extra:
        df = df.withColumn(name, __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    return df


def lowered(text):
    return (text or "").translate(UPPER)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def entropy(string, window=20):
    best = 0.0
    for i in range(max(1, len(string) - window + 1)):
        part = string[i : i + window]
        best = max(best, -sum(n / len(part) * log2(n / len(part)) for n in Counter(part).values()))
    return best
