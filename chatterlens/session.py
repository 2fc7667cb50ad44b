"""Session defaults for local runs and clusters."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="chatterlens-"), "chatterlens")
    archive = shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)


def build_session(app: str = "chatterlens", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution on.

    Nothing here fixes a partition count for a cluster: AQE coalesces from
    ``spark.sql.shuffle.partitions``, which the submitter sizes to the data.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoint into the shared folder the cluster names; into a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = os.path.join(tempfile.gettempdir(), "chatterlens-checkpoints")
    context.setCheckpointDir(named)


def written_once(df: DataFrame) -> DataFrame:
    """The frame checkpointed, for plans that read it several times.

    It survives lost executors, and what made it (a scan of texts, a join) runs once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
