"""What driver and executors share: the folder for intermediate tables, and this package's code."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session: their Python workers import it wherever they were started."""
    sc, name = spark.sparkContext, f"{PACKAGE.name}-{spark.sparkContext.applicationId}.zip"
    if any(os.path.basename(f) == name for f in sc.listFiles):
        return
    path = os.path.join(tempfile.mkdtemp(prefix=f"{PACKAGE.name}-"), name)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or what was set as checkpoint folder.

    Where neither is set, a temporary folder in local mode (tests), and an error on a cluster, whose machines would not share it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracelode-"))
    return named or sc.getCheckpointDir()


def spread(rows: DataFrame) -> DataFrame:
    """Rows just read from files, dealt out over all cores where they come in fewer splits than there are cores: a small table is
    one row group, and so one task, however much work each row is. Larger tables stay as they are read, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() > cores else rows.repartition(cores)


def removed(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of intermediate files that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialises a table in the shared folder: later plans start from it, and lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
