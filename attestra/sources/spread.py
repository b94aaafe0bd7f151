"""Dealing narrow rows over tasks by their number.

Spark cuts files by bytes. A file of few bytes can hold very many rows, and where each of them costs
long work (a label's rules take a thousand times as long as reading its row), one task would do it all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 2_000
MOST_TASKS = 4_096  # beyond that a task gets more rows


def spread(rows: DataFrame, *keys: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The same rows dealt over tasks by ``keys``, which should be unique together.

    Call it on a table as it is read: its rows are counted first, which Parquet answers from its
    footers, and the columns that a query does not read are not moved.
    """
    tasks = min(MOST_TASKS, -(-rows.count() // rows_per_task))
    return rows if tasks <= 1 else rows.repartition(tasks, *keys)


def spread_texts(rows: DataFrame, *keys: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """As ``spread`` for rows with long texts, which move only where few tasks would hold them all.

    Parquet is cut between row groups only, so a large file with one of them is one task. Where no
    part is more than half of a core's share, the rows stay where they are.
    """
    total, largest = rows.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if not total or largest <= max(rows_per_task, total // (2 * cores)):
        return rows
    return rows.repartition(min(MOST_TASKS, -(-total // rows_per_task)), *keys)
