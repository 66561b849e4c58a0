"""Session defaults, checkpoint location and table loading."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "tracewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, skew-join handling and Arrow transfer switched on.

    On a cluster the master, memory and partition numbers come from spark-submit; nothing
    here overrides a value that is already set.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application.

    Workers then need neither an installation nor a particular working directory.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="tracewell-"), "tracewell.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.join("tracewell", os.path.relpath(path, root)))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between jobs: ``spark.checkpoint.dir``, which all executors share.

    Only where it is unset and everything runs in one local process is a private folder made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="tracewell-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; the data survives the loss of an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


SPREAD = "spark.tracewell.spreadTasks"


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt anew over the number of tasks that the caller set as ``spark.tracewell.spreadTasks``.

    Unset, as on a cluster, rows stay in the splits they were read in; a shuffle of all texts would
    cost more than it gains. It helps with a few small files of one row group each.
    """
    tasks = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(tasks) if tasks > 0 else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
