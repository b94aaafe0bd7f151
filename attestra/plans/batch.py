"""The verification runs: manifest batch, one application over many labels, direct text."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.constants import MANUAL_FILE_NAME
from attestra.functions.extract import clean_lines, extracted_fields
from attestra.operators import matching, performance, reports
from attestra.operators.results import missing_file_result
from attestra.operators.rules import FROM_FILE, FROM_TEXT, verify_labels
from attestra.schema import Application, RuleOptions, SlaOptions
from attestra.sources.label_text import label_text

APPLICATION = (
    "brand_name", "class_type", "beverage_type", "alcohol_content", "proof", "net_contents",
    "producer_bottler", "imported", "importer", "country_of_origin", "cola_id", "notes",
)
COPIES_PER_TASK = 10_000
BROADCAST_NAMES = 50_000  # matched records up to this number are sent to the texts


def _finish(checked: DataFrame, created_on: Column | None) -> DataFrame:
    """Report columns common to all runs."""
    cleaned = checked.withColumn("_lines", clean_lines(F.col("raw_text")))
    return cleaned.withColumns({
        "extracted": extracted_fields(F.col("raw_text"), F.col("_lines")),
        "processing_seconds": F.coalesce(F.col("ocr_seconds"), F.lit(0.0)),
        "created_on": F.current_timestamp() if created_on is None else created_on,
    }).drop("_lines")


def matched_labels(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """Label texts with the application of their name: last record, last upload.

    Names are aggregated before they meet. Counted few, the matched records go to the texts,
    which do not move; else both join on the texts' unique row id, which spreads evenly
    whatever the names are. Equal rows without an id of their own are one upload.
    """
    texts = label_text(texts)
    records = matching.last_records(manifest).drop("row_id", "file_name")
    winners = matching.last_uploads(texts).select("key", "upload_row")
    matched = records.join(winners, "key").drop("key")
    few = matched.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    digests = texts.schema["row_id"].dataType.simpleString() == "string"
    joined = texts.withColumnRenamed("row_id", "upload_row").join(
        F.broadcast(matched) if few else matched, "upload_row")
    return joined.dropDuplicates(["upload_row"]) if digests else joined


def missing_reports(manifest: DataFrame, texts: DataFrame,
                    created_on: Column | None = None) -> DataFrame:
    """A needs-review report for each manifest name without a text."""
    missing = matching.missing_names(manifest, label_text(texts))
    blank = {c: F.lit("") for c in APPLICATION}
    blank.update(
        alcohol_content=F.lit(None).cast("double"), proof=F.lit(None).cast("double"),
        imported=F.lit(False), beverage_type=F.lit(Application.beverage_type))
    return _finish(missing.select(
        "file_name", F.lit("").alias("raw_text"), F.lit("").alias("ocr_engine"),
        F.lit(0.0).alias("ocr_seconds"),
        F.array().cast("array<string>").alias("image_quality_notes"),
        *[v.alias(k) for k, v in blank.items()], "occurrences",
        F.array(missing_file_result()).alias("results")), created_on)


def verify_batch(manifest: DataFrame, texts: DataFrame, options: RuleOptions = RuleOptions(),
                 created_on: Column | None = None, with_missing: bool = True) -> DataFrame:
    """One report row per manifest name, ``occurrences`` telling how often it is listed.

    A name is verified once however often the manifest repeats it; ``expand_occurrences``
    gives one row per listing. Several outputs should read a stored copy of this table.
    """
    checked = verify_labels(matched_labels(manifest, texts), options)
    done = _finish(checked, created_on)
    columns = ["file_name", "raw_text", "ocr_engine", "ocr_seconds", "image_quality_notes",
               *APPLICATION, "occurrences", "results", "extracted", "processing_seconds",
               "created_on"]
    verified = done.select(*columns, F.lit(True).alias("processed"))
    if not with_missing:
        return verified
    return verified.unionByName(missing_reports(manifest, texts, created_on).select(
        *columns, F.lit(False).alias("processed")))


def expand_occurrences(table: DataFrame) -> DataFrame:
    """One row per manifest listing. Copies are made in slices spread over tasks, so a name
    that holds a large share of the manifest does not expand in one place; rows listed once
    stay where they are."""
    once = table.where(F.col("occurrences") <= 1).drop("occurrences")
    table = table.where(F.col("occurrences") > 1)
    slices = F.sequence(F.lit(0), ((F.col("occurrences") - 1) / COPIES_PER_TASK).cast("int"))
    sliced = table.withColumn("slice", F.explode(slices))
    left = F.col("occurrences") - F.col("slice") * COPIES_PER_TASK
    copies = F.least(left, F.lit(COPIES_PER_TASK)).cast("int")
    spread = sliced.repartition("file_name", "slice")
    return once.unionByName(spread.withColumn(
        "copy", F.explode(F.sequence(F.lit(1), copies))).drop("slice", "copy", "occurrences"))


def verify_application(application: Application, texts: DataFrame,
                       options: RuleOptions = RuleOptions(),
                       created_on: Column | None = None, manual: bool = False) -> DataFrame:
    """One application against many labels: its values become literals, so nothing joins."""
    kinds = {"alcohol_content": "double", "proof": "double", "imported": "boolean"}
    values = {k: F.lit(v).cast(kinds.get(k, "string")) for k, v in asdict(application).items()}
    labels = label_text(texts, manual=manual).withColumns(values)
    # Text that was supplied must be there; recognized text may be missing and is then reviewed.
    return _finish(verify_labels(labels, options, FROM_TEXT if manual else FROM_FILE), created_on)


def verify_text(spark, application: Application, text: str, file_name: str = MANUAL_FILE_NAME,
                options: RuleOptions = RuleOptions()) -> DataFrame:
    """Direct text of one label."""
    frame = spark.createDataFrame([(file_name, text)], "file_name string, raw_text string")
    return verify_application(application, frame, options, manual=True)


@dataclass(frozen=True)
class BatchTables:
    """The outputs of a manifest batch, all lazy over the stored reports.

    ``reports`` has a row per name with its ``occurrences``; summary, details, comparison and
    performance have one per manifest listing.
    """

    reports: DataFrame
    summary: DataFrame
    details: DataFrame
    comparison: DataFrame
    performance: DataFrame
    timing: DataFrame
    batch_acceptance: DataFrame
    validation: DataFrame
    warnings: DataFrame
    skipped: DataFrame


def run_manifest_batch(manifest: DataFrame, texts: DataFrame, store: str | None = None,
                       options: RuleOptions = RuleOptions(), sla: SlaOptions = SlaOptions(),
                       created_on: Column | None = None) -> BatchTables:
    """All tables of a batch. With ``store``, a shared folder, the reports are written there
    once and every output reads that copy; without it each output verifies anew."""
    texts = label_text(texts)
    table = verify_batch(manifest, texts, options, created_on)
    if store is not None:
        table.write.mode("overwrite").parquet(f"{store}/reports")
        table = manifest.sparkSession.read.parquet(f"{store}/reports")
    listed = expand_occurrences(table)
    timings = table.where("processed").select("file_name", "processing_seconds", "occurrences")
    timing = performance.timing_acceptance(
        performance.timing_summary(timings, sla, weight="occurrences"), sla)
    skipped = matching.missing_names(manifest, texts).select("file_name").unionByName(
        matching.extra_names(manifest, texts).select("file_name"))
    return BatchTables(
        reports=table,
        summary=reports.summary(listed),
        details=reports.detail(listed),
        comparison=reports.evidence_comparison(listed),
        performance=performance.performance_table(
            listed.where("processed").select("file_name", "processing_seconds"), sla),
        timing=timing,
        batch_acceptance=performance.batch_acceptance(timing, sla),
        validation=matching.validation_record(manifest, texts),
        warnings=matching.duplicate_upload_warnings(texts).unionByName(
            matching.extra_upload_warnings(manifest, texts)),
        skipped=skipped)
