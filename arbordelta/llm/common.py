"""Shared helpers: table access and tables written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.code import arrow_map, ship

__all__ = ["WORD", "arrow_map", "fresh", "materialize", "new_path", "read_table", "shared_folder", "ship", "staged", "text_or_empty"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one if driver and executors are one process."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="arbordelta-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path that no other run has; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/arbordelta-{tag}-{uuid.uuid4().hex}"
    system, at = _on_disk(spark, path)
    system.deleteOnExit(at)
    if _RECORDED is not None:
        _RECORDED.append(path)
    return path


def _on_disk(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Paths made since recording began, and those that the last stage of an application made.
_RECORDED: list[str] | None = None
_OF_STAGE: dict[str, list[str]] = {}


def staged(stage):
    """A pipeline stage: what the stage before wrote for itself goes when this one begins, as its result is written by then."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _RECORDED
        application = spark.sparkContext.applicationId
        for path in _OF_STAGE.pop(application, []):
            system, at = _on_disk(spark, path)
            system.delete(at, True)
        _RECORDED = _OF_STAGE[application] = []
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _RECORDED = None

    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as tell it from the columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Spark's setting that shuffle files go when the execution that made them ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, survives lost executors. The write's shuffle files go with it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


WORD = r"[^\x20\x09-\x0D]+"
