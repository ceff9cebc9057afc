"""Small tables with what the operators must bear."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], DOCS)


def clashing(df):
    """df with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = [c for c in ("key", "rank", "fp", "node", "sha", "rep", "blobs", "cuts", "copy", "at", "score", "label", "count", "grp", "text_", "rest", "id", "n", "a", "b", "hash", "other_id") if c not in df.columns]
    return df.select("*", *[F.lit(1).alias(c) for c in names])


def rows(df, *names):
    """Sorted rows as tuples of strings, so nulls sort too."""
    return sorted(tuple(str(r[n]) for n in (names or df.columns)) for r in df.collect())


def same_with_more_columns(f, df):
    a, b = f(df), f(clashing(df))
    return rows(a) == rows(b, *a.columns)
