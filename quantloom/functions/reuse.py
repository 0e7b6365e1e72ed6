"""Frames that several later steps read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: a reliable checkpoint where the session names a folder for them, else cached.

    A checkpoint cuts the lineage, survives the loss of an executor, and goes when nothing refers to it any more
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    if df.sparkSession.sparkContext.getCheckpointDir() is not None:
        return df.checkpoint()
    return df.persist()
