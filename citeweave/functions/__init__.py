"""Functions of texts, and their names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf


def register(spark: SparkSession) -> None:
    """indel_ratio(a, b), token_sort_ratio(a, b) and parse_paragraph(text) for SQL."""
    from citeweave.functions import similarity
    from citeweave.operators import tokenise

    spark.udf.register("indel_ratio", pandas_udf(similarity.ratios, "double"))
    spark.udf.register("token_sort_ratio", pandas_udf(similarity.token_ratios, "double"))
    spark.udf.register("parse_paragraph", pandas_udf(tokenise.parse_series, tokenise.STRUCT))
