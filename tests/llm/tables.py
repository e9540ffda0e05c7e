"""Small tables with the cases that every operator has to stand."""

from __future__ import annotations

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHING = ("size", "_size", "_copies", "_removed", "_cut", "_toxicity", "component_id", "text_hash", "score", "rank", "key", "host", "shape")


def documents(spark, texts, sources=None, clashing=True):
    """Documents with ids 0, 1, ... and the given texts; a pair (id, text) gives the id."""
    rows = []
    for k, t in enumerate(texts):
        doc_id, text = t if isinstance(t, tuple) else (k, t)
        rows.append((doc_id, text, "en", sources[k] if sources else f"s{k % 3}", len(text) if text is not None else None))
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING]) if clashing else df


def words(rng, n, vocabulary=5000):
    return [f"w{int(k)}" for k in rng.integers(0, vocabulary, n)]
