"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one table of a dataset directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` wins where it is set.  A temporary folder is made
    only in local mode, where driver and executors are one process; a cluster
    without a shared folder is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None and sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="helixmill-checkpoint-"))


def ensure_adaptive(spark: SparkSession) -> None:
    """Adaptive execution with its handling of skewed joins, on which joins on natural keys rely."""
    for name in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"):
        if spark.conf.get(name, "true") != "true":
            spark.conf.set(name, "true")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its plan.

    This runs a job at once.  Spark removes the files of tables that are no
    longer referred to where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set; else they stay until the folder is cleared.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession) -> str:
    """A new name in the shared folder of the session, for tables that are written and read again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Rows in as many partitions as the session sets for shuffles.

    For stages whose cost is Python time: by bytes they look small, and the
    planner would merge them into a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def busy(scan: DataFrame) -> DataFrame:
    """The rows of a plain scan in as many partitions as there are cores at least.

    A table of one small file is one partition, and Python stages over it would
    run on one core.  Larger tables have more partitions and stay as they are.
    Only for scans: a plan with shuffles would be run to count its partitions.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their Python workers can import it.

    The archive is written on the driver and served by Spark's own file server.
    """
    ensure_adaptive(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="helixmill-"), "helixmill_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
