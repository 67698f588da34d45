"""Session settings the library relies on, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    # Days, buckets and ISO text are all UTC.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key is legal; the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Rebalanced writes and small-side joins are sized at run time.
    "spark.sql.adaptive.enabled": "true",
}

_SHARED_KEY = "emberlog.shared.dir"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator assumes to an existing session."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; a cluster must name one.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(_SHARED_KEY, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="emberlog-")
    spark.conf.set(_SHARED_KEY, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/emberlog/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage durably, so a lost executor never recomputes it, and lets later passes prune columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
