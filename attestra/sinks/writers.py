"""Redacted exports: CSV, JSON, evidence packages, error-log appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators.redaction import error_log_rows, redact_nested, redact_table
from attestra.schema import RetentionOptions


def write_redacted_csv(df: DataFrame, path: str,
                       options: RetentionOptions = RetentionOptions()) -> bool:
    """Write the redacted table; nothing when the policy forbids it or there are no rows."""
    if not options.can_write_evidence or df.isEmpty():
        return False
    redact_table(df, options).write.mode("overwrite").csv(path, header=True, escape='"')
    return True


def json_lines(df: DataFrame, options: RetentionOptions = RetentionOptions()) -> DataFrame:
    """One JSON object per row, nested keys redacted, nulls kept."""
    safe = redact_nested(df, options)
    return safe.select(F.to_json(
        F.struct(*[F.col(f"`{c}`") for c in safe.columns]),
        {"ignoreNullFields": "false"}).alias("value"))


def write_redacted_json(df: DataFrame, path: str,
                        options: RetentionOptions = RetentionOptions()) -> bool:
    if not options.can_write_evidence:
        return False
    json_lines(df, options).write.mode("overwrite").text(path)
    return True


def write_markdown(lines: DataFrame, path: str,
                   options: RetentionOptions = RetentionOptions()) -> bool:
    """Write ``(position columns..., line)`` rows as text, in position order."""
    if not options.can_write_evidence:
        return False
    order = [c for c in lines.columns if c != "line"]
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
    return True


def write_outputs(tables: dict[str, DataFrame], reports: dict[str, DataFrame], folder: str,
                  options: RetentionOptions = RetentionOptions(), as_json: tuple[str, ...] = ()) -> DataFrame:
    """Write an evidence package and return its index: ``output, format, path, written``.

    Every table becomes redacted CSV in a folder of its own, those of ``as_json`` redacted JSON as
    well, and every table of report lines Markdown. The index is written beside them. Nothing is
    written when the policy forbids it, and no folder for a table without rows.
    """
    spark = next(iter({**tables, **reports}.values())).sparkSession
    index = []

    def add(name, kind, written, path):
        index.append((name, kind, path if written else "", written))

    for name, table in tables.items():
        path = f"{folder}/{name}_redacted_csv"
        add(name, "csv", write_redacted_csv(table, path, options), path)
        if name in as_json:
            path = f"{folder}/{name}_redacted_json"
            add(name, "json", write_redacted_json(table, path, options), path)
    for name, lines in reports.items():
        path = f"{folder}/{name}_redacted_md"
        add(name, "markdown", write_markdown(lines, path, options), path)
    manifest = spark.createDataFrame(index, "output string, format string, path string, written boolean")
    if options.can_write_evidence:
        manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/package_manifest_json")
    return manifest


def append_error_log(errors: DataFrame, path: str) -> None:
    """Append sanitized rows, partitioned by day so that retention can drop whole days."""
    rows = error_log_rows(errors).withColumn("day", F.to_date("created_on"))
    rows.write.mode("append").partitionBy("day").parquet(path)
