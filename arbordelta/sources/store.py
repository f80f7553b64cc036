"""Documents and trees kept in Parquet: upserts, reads by key and key lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import display_name


def upsert(old: DataFrame, new: DataFrame, key: str = "slug", order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those with the same key. Of several new rows with a key the last by `order` counts."""
    if order is not None:
        new = new.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update_existing(old: DataFrame, new: DataFrame, column: str, key: str = "slug") -> DataFrame:
    """old with `column` taken from new where the key is in both; new keys are not added."""
    values = new.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    joined = old.join(values, key, "left")
    current = F.col(column) if column in old.columns else F.lit(None)
    return joined.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(current)).drop("_new", "_hit")


def slugs(documents: DataFrame) -> DataFrame:
    return documents.select("slug").distinct().orderBy("slug")


def entity_index(documents: DataFrame) -> DataFrame:
    """slug, name: the display name, or the slug with capitals."""
    return documents.select("slug", display_name("country_name", "slug").alias("name")).orderBy("slug")


def read_one(spark: SparkSession, path: str, slug: str, *columns: str) -> DataFrame:
    """A document by key; Parquet statistics and the columns asked for bound what is read."""
    df = spark.read.parquet(path).where(F.col("slug") == slug)
    return df.select(*columns) if columns else df
