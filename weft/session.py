"""Session helpers: reading tables, and staging intermediate results in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent and Spark runs on one machine (tests) a temporary folder takes its place; on a cluster it must be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below the folder of this application (see drop_staged)."""
    return f"{shared_dir(spark)}/weft-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def drop_staged(spark: SparkSession) -> None:
    """Removes all that this application has staged; to be called when its results are written."""
    drop_path(spark, f"{shared_dir(spark)}/weft-{spark.sparkContext.applicationId}")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """A scanned table over at least as many partitions as there are cores: matters for small inputs only, where one file would keep
    all Python work in one task. Not for plans with a shuffle, which asking for partitions would run."""
    n = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(n) if table.rdd.getNumPartitions() < n else table


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a path that this run wrote."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
