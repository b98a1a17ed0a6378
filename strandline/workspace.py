"""Shared scratch space and session helpers.

Every table an operator writes between its steps goes to the folder the cluster names in
``spark.checkpoint.dir``, which all executors reach, so a lost executor costs a re-run of tasks and
never a result.  Only where that setting is missing on a local master (tests, a laptop) a temporary folder is used.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the session names none and runs in one process.

    Raises RuntimeError on a cluster without that setting: executors wouldn't see each other's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(_fallback[app])
    return _fallback[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one written table; the file system drops it when the application ends."""
    path = f"{shared_dir(spark)}/strandline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back with the same schema."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
