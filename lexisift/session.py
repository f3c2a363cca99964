"""Paths shared by the cluster, taken from the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, as in tests, a folder of this machine, set for the session."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        conf = got.get() if got.isDefined() else None
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="lexisift-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


#: Folders made by this process, by application, for ``clean_up``.
_MADE: dict[str, list[str]] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Deletes what queries of this application wrote to the shared folder, once their results are stored or read; gives how many
    folders that were. Tables that are still to be computed from them can't be any more."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    conf = spark._jsc.hadoopConfiguration()
    for path in made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(made)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
