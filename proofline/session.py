"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every job here relies on.

    On a cluster, leave both arguments unset: the master and the partition count come from the
    submit configuration and adaptive execution coalesces small shuffles.
    """
    builder = (
        SparkSession.builder.appName("proofline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Where it is unset, a local master (one machine, as in tests) gets a folder under spark.local.dir; on any other
    master that is an error, as each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    master = spark.sparkContext.master
    if not re.match(r"local($|\[)", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    root = os.path.join(spark.conf.get("spark.local.dir", None) or "/tmp", f"spark-{uuid.uuid4().hex}")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


#: Intermediate tables of this process that are not deleted yet.
_written: list[str] = []


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the intermediate tables written so far and returns their number. Call it when the results that were built on them are
    written: frames that still read them fail afterwards."""
    conf, count = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        count += bool(path.getFileSystem(conf).delete(path, True))
    return count


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    The result outlives lost executors, its lineage is a file scan, it is computed once however
    often it is read, and its real size, not an estimate, decides whether a join broadcasts it.
    """
    path = scratch_path(df.sparkSession, label)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
