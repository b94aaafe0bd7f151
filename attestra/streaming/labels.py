"""Incremental verification: arriving label texts against a static manifest.

The rules are a narrow projection, so the batch functions serve streams as they are. Nothing is
kept between triggers and each text is verified when it arrives, so there is no last-upload
rule across triggers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from attestra.functions.text import base_name
from attestra.operators.matching import last_records, name_key
from attestra.operators.rules import verify_labels
from attestra.schema import RuleOptions
from pyspark.sql import functions as F


def verify_stream(texts: DataFrame, manifest: DataFrame,
                  options: RuleOptions = RuleOptions()) -> DataFrame:
    """Streaming ``texts`` need file_name, raw_text and image_quality_notes."""
    records = last_records(manifest).drop("row_id", "file_name", "occurrences")
    keyed = texts.withColumn("key", name_key(base_name(F.col("file_name"))))
    return verify_labels(keyed.join(records, "key").drop("key"), options)


def start_verification(texts: DataFrame, manifest: DataFrame, path: str, checkpoint: str,
                       options: RuleOptions = RuleOptions()) -> StreamingQuery:
    """Append verified labels to a parquet table; ``checkpoint`` is a shared folder."""
    return (
        verify_stream(texts, manifest, options).writeStream.format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start())
