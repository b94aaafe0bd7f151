"""Helpers that several operators share: tables, shared folders, ranks, word splitting."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hash buckets a rank is counted in, so that no task has to order a hot key alone.
RANK_BUCKETS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@lru_cache(maxsize=1)
def local_folder() -> str:
    """The temporary folder of this process; the setting itself cannot change in a running session."""
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the cluster's checkpoint folder; local sessions get a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = local_folder()
    return f"{base.rstrip('/')}/attestra-{uuid.uuid4().hex}"


#: Folders and tables that this thread has settled since ``settle_last`` began.
_LOCAL = threading.local()


def _note(path: str, table: str | None = None) -> None:
    for held in getattr(_LOCAL, "open", []):
        held.append((path, table))


def settle(df: DataFrame) -> DataFrame:
    """Write rows to the shared folder and read them back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    _note(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(settled: DataFrame) -> None:
    """Delete the folder of a settled table; what was made from it must have been settled itself."""
    for folder in {f.rpartition("/")[0] for f in settled.inputFiles()}:
        if folder.rpartition("/")[2].startswith("attestra-"):
            _delete(settled.sparkSession, folder)


def settle_last(make: Callable[[], DataFrame]) -> DataFrame:
    """Settle what ``make`` gives and delete all that was settled on the way to it."""
    if not hasattr(_LOCAL, "open"):
        _LOCAL.open = []
    held: list[tuple[str, str | None]] = []
    _LOCAL.open.append(held)
    try:
        made = make()
    finally:
        _LOCAL.open.pop()
    done = settle(made)
    spark = done.sparkSession
    for path, table in held:
        if table is not None:
            spark.sql(f"drop table if exists {table}")
        _delete(spark, path)
    return done


def settle_by(df: DataFrame, key: str) -> DataFrame:
    """As ``settle``, in buckets of ``key``: later joins on it do not shuffle these rows again."""
    spark = df.sparkSession
    path = shared_dir(spark)
    name = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    _note(path, name)
    return spark.table(name)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def as_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``, so that columns added beside it cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def content_key(*columns: Column) -> Column:
    """128 bits that equal values share, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws("\x1f", *columns).cast("binary"))


def ranked(df: DataFrame, keys: list[str], order: str, name: str = "rank",
           buckets: int = RANK_BUCKETS) -> DataFrame:
    """Add each row's place (from 1) within ``keys`` by the long column ``order``, in no one task.

    Rows of a key are counted per range of ``order``; a row's place is the count of the ranges
    before plus its place in its own range. ``order`` should be a hash, so ranges are alike. Equal
    values get places in any order. Pass a settled table: it is read twice.
    """
    width = float((1 << 64) // buckets)
    bucketed = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(width)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order)
    return (bucketed.join(offsets, [*keys, "_bucket"])
            .withColumn(name, F.col("_before") + F.row_number().over(inner))
            .drop("_bucket", "_before"))
