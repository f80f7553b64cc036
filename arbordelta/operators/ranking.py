"""Top-k similarity ranking of one tree against all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ted


def rank(trees: DataFrame, tree_id: str, top_k: int = 5, algorithm: str = "chawathe", root_label: str | None = "infobox") -> DataFrame:
    """rank, tree_id, distance, similarity of the top_k most similar trees but the query; ties go to the smaller id.

    The query is one row, so it is broadcast. The limit makes a top-k per partition before one small merge.
    """
    one = trees.where(F.col("tree_id") == tree_id).select(F.col("tree_id").alias("source_id"), F.col("seq").alias("a")).limit(1)
    every = trees.where(F.col("tree_id") != tree_id).select(F.col("tree_id").alias("target_id"), F.col("seq").alias("b"))
    pairs = every.crossJoin(F.broadcast(one))
    top = ted.distances(pairs, algorithm, root_label).where("distance is not null").orderBy(F.desc("similarity"), "target_id").limit(top_k)
    numbered = F.row_number().over(_one_task().orderBy(F.desc("similarity"), "target_id"))
    return top.select(numbered.alias("rank"), F.col("target_id").alias("tree_id"), F.col("distance"), "similarity")


def _one_task():
    from pyspark.sql import Window

    return Window.partitionBy()  # top_k rows


def rank_both(trees: DataFrame, tree_id: str, top_k: int = 5) -> DataFrame:
    """Rankings by chawathe and nj; a top_k outside 1..50 means 5."""
    k = top_k if 1 <= top_k <= 50 else 5
    parts = [rank(trees, tree_id, k, a).withColumn("algorithm", F.lit(a)) for a in ("chawathe", "nj")]
    return parts[0].unionByName(parts[1])
