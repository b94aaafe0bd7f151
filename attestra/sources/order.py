"""Where rows stand in their files, for "the last one wins" without an order column.

Spark reads files in parts of any order. A row's place is its file (by path), its part's place
within the file and its place within the part; all three come from the scan itself, so every
evaluation of the same files agrees.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the columns that ``placed`` adds.
FILE, PART, ROW = "_file", "_part", "_row"


def _has(df: DataFrame, field: str) -> bool:
    try:
        df.select(F.col(f"_metadata.{field}"))
    except AnalysisException:
        return False
    return True


def source_place(df: DataFrame) -> Column | None:
    """An orderable, unique struct per row of a table that is read from files; None for others.

    Call it on the table as it is read, before joins, filters or aggregations. Parquet knows the
    row's index in its file; other formats give the part's start and the row's place in the part.
    """
    if not _has(df, "file_path"):
        return None
    path = F.col("_metadata.file_path").alias("file")
    if _has(df, "row_index"):
        return F.struct(path, F.lit(0).cast("bigint").alias("part"), F.col("_metadata.row_index").alias("row"))
    return F.struct(path, F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))


def placed(df: DataFrame) -> DataFrame:
    """A table read from files with its place columns; all other columns stay."""
    return df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(PART),
                     F.monotonically_increasing_id().alias(ROW))


def numbered(rows: DataFrame, name: str = "row_id") -> DataFrame:
    """Replace the place columns by running numbers from 0 over all files, in path order.

    Only the counts of the files' parts are summed up in one place. Rows of a part follow each other,
    so a row's number is its part's first number plus how far it stands from the part's first row.
    """
    parts = rows.groupBy(FILE, PART).agg(F.count(F.lit(1)).alias("_n"), F.min(ROW).alias("_first"))
    before = Window.orderBy(FILE, PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (FILE, PART, ROW)]
    return rows.join(starts, [FILE, PART]).select(
        *kept, (F.col("_before") + F.col(ROW) - F.col("_first")).alias(name))
