"""Partition layout of the registered queries' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

# A scan is dealt over at least this many tasks, at most one per core.
FEW_SPLITS = 16
# Tasks for each split of a scan, so that one is done in minutes also where rows are costly.
TASKS_A_SPLIT = 4
# A scan of this many splits has work for every core and is left as it is.
MANY_SPLITS = 256


def dealt_tasks(scan: DataFrame) -> int:
    """Over how many tasks :func:`dealt` spreads a bare scan, known without running anything."""
    n = scan.rdd.getNumPartitions()
    return n if n >= MANY_SPLITS else max(min(FEW_SPLITS, scan.sparkSession.sparkContext.defaultParallelism), TASKS_A_SPLIT * n)


def dealt(scan: DataFrame) -> DataFrame:
    """A table scan with its rows dealt evenly over tasks.

    For callers that are about to do costly work per row; operators never change
    their input's layout.  The number of splits says nothing about their rows: all rows
    of a Parquet row group go to the split that holds its middle, and the other splits
    of that row group are empty.  ``scan`` must be a bare scan.
    """
    n = dealt_tasks(scan)
    return scan if scan.rdd.getNumPartitions() >= MANY_SPLITS else scan.repartition(n)
