"""What plans tell of sizes: partitions that follow the input, and broadcasts of tables that were counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of files for one partition of a shuffle that moves most of their rows.
PARTITION = 4_000_000
#: Rows of a table that is still sent to every executor.
SMALL = 100_000


def partitions(df: DataFrame) -> int:
    """For a shuffle of df: as many as the files that it reads call for, and the session's at least, so that a task's share doesn't grow with the input."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    total = sum(n for n in known if n < 1 << 60)  # a table from Python has no known size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION))


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows. For seeds: they come from Python, so Spark would take them for large and move the facts instead."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df
