"""Session helpers shared by the whole library."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers; done once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="talespan-"), "talespan_src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir; make one only in local mode where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        one_machine = context.master.startswith("local") and not context.master.startswith("local-cluster")
        if not shared and not one_machine:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="talespan-ckpt-"))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage by a written table in the shared folder, of which later steps read only the fields that they need.

    The files stay until the folder is deleted.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_files(spark: SparkSession, path: str) -> None:
    """Delete a folder that a step wrote and nothing reads any more, by Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, again: float = 0) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that nothing refers to any more.

    Files go when the driver collects its garbage, which it may not do for long while disks fill. Those of the
    last step are found by a second collection, so many seconds later.
    """
    for pause in (0, again) if again else (0,):
        time.sleep(pause)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
