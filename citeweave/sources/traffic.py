"""A daily traffic log: read, and new days put in place of old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "date date, views long, unique_views long, clones long, unique_clones long"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=SCHEMA, header=True)


def upserted(log: DataFrame, days: DataFrame) -> DataFrame:
    """One row per day, the new one where there are both, in order."""
    both = log.withColumn("_new", F.lit(0)).unionByName(days.select(*log.columns).withColumn("_new", F.lit(1)))
    latest = both.withColumn("_n", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("_new"))))
    return latest.where("_n = 1").drop("_n", "_new").orderBy("date")
