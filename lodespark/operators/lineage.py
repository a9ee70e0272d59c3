"""Cutting the lineage of iterative queries in a folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed to spark.checkpoint.dir; only in local mode, where that may be unset, to a temporary folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():  # Spark reads the setting at its start; here it was unset, or set since
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="lodespark-")
        context.setCheckpointDir(found)
    return df.checkpoint()
