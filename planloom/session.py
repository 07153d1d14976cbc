"""Session helpers: table access, the shared scratch folder, materialisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Intermediate tables of each application, for ``forget_tables``.
_written: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where neither the setting nor a checkpoint folder exists (local tests)
    a temporary folder is created and set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        # A folder of one machine cannot be read by executors on others; local masters, local-cluster too, are all on one.
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="planloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def forget_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables that this session wrote; call it when no result that reads them is needed any more."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        drop_table(spark, path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{scratch_dir(spark)}/planloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a table every executor can read again, so a lost
    executor costs a task, not the plan; the result's size is known to the
    optimizer afterwards.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition for costly work on rows that are few bytes: adaptive execution would merge them into one task.

    Rows go by a hash of the keys' hash: a repartition by the keys themselves is dropped
    as redundant where an aggregation or join by them stands before it.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, F.xxhash64(*keys)) if keys else df.repartition(n)
