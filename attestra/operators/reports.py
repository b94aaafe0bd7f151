"""Tables derived from verified labels: statuses, summaries, details, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.constants import (
    FAIL, OVERALL_FIELD, PASS, REVIEW, REVIEWER_ACTION_DEFAULT, REVIEWER_ACTIONS,
    STATUS_BADGES, STATUSES, TEXT_FIELD, WARNING,
)
from attestra.functions.extract import field_map
from attestra.functions.text import has_text, strip

DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _needs_review(r: Column) -> Column:
    return (r["status"] == REVIEW) | r["requires_human_review"]


def failures(results: Column) -> Column:
    return F.size(F.filter(results, lambda r: r["status"] == FAIL))


def warnings(results: Column) -> Column:
    return F.size(F.filter(results, lambda r: r["status"] == WARNING))


def reviews(results: Column) -> Column:
    return F.size(F.filter(results, _needs_review))


def overall_status(results: Column) -> Column:
    """Worst outcome of a label; a review flag outweighs a warning, a failure both."""
    return (
        F.when(F.coalesce(F.size(results), F.lit(0)) <= 0, REVIEW)
        .when(F.exists(results, lambda r: r["status"] == FAIL), FAIL)
        .when(F.exists(results, _needs_review), REVIEW)
        .when(F.exists(results, lambda r: r["status"] == WARNING), WARNING)
        .otherwise(PASS))


def status_line(results: Column) -> Column:
    return F.format_string(
        "%s: %d failures, %d warnings, %d review items", overall_status(results),
        failures(results), warnings(results), reviews(results))


def detail_rows(reports: DataFrame, *keep: str) -> DataFrame:
    """One row per rule result. The outer form keeps Catalyst from adding a filter on the
    array size, which would copy the whole rule projection below itself."""
    flat = reports.select("file_name", *keep, F.posexplode_outer("results").alias("ordinal", "r"))
    return flat.select("file_name", *keep, "ordinal", "r.*")


def detail(reports: DataFrame) -> DataFrame:
    """The ten detail columns, in report order of the rules."""
    rows = detail_rows(reports)
    return rows.select(
        F.col("file_name").alias("File Name"), F.col("field_name").alias("Field Name"),
        F.col("rule_id").alias("Rule ID"), F.col("status").alias("Status"),
        F.col("severity").alias("Severity"), F.col("expected").alias("Expected"),
        F.col("observed").alias("Observed"), F.round("confidence", 2).alias("Confidence"),
        F.col("evidence").alias("Evidence"), F.col("message").alias("Message"))


def summary(reports: DataFrame) -> DataFrame:
    """One row per label."""
    none = F.coalesce(F.size("results"), F.lit(0)) <= 0
    results = F.col("results")
    return reports.select(
        F.col("file_name").alias("File Name"), F.col("brand_name").alias("Brand Name"),
        F.col("beverage_type").alias("Beverage Type"),
        F.when(has_text(F.col("raw_text")), "Found").otherwise("Not Found").alias(TEXT_FIELD),
        overall_status(results).alias(OVERALL_FIELD),
        F.when(none, 0).otherwise(failures(results)).alias("Failures"),
        F.when(none, 0).otherwise(warnings(results)).alias("Warnings"),
        F.when(none, 1).otherwise(reviews(results)).alias("Needs Review"),
        F.round("processing_seconds", 2).alias("Processing Seconds"),
        F.date_format("created_on", DATE_FORMAT).alias("Created On"))


def batch_totals(reports: DataFrame) -> DataFrame:
    """Labels, and labels with at least one failure, warning or review."""
    results = F.col("results")
    weight = F.col("occurrences") if "occurrences" in reports.columns else F.lit(1)

    def count(condition):
        return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("bigint")

    return reports.agg(
        count(F.lit(True)).alias("total_files"),
        count(F.exists(results, lambda r: r["status"] == FAIL)).alias("total_failures"),
        count(F.exists(results, lambda r: r["status"] == WARNING)).alias("total_warnings"),
        count(F.exists(results, _needs_review)).alias("total_reviews"))


def dashboard(reports: DataFrame, timing_summary: DataFrame) -> DataFrame:
    """Batch totals beside the SLA breaches; both sides have one row."""
    breaches = timing_summary.select(F.col("sla_breach_count").alias("sla_breaches"))
    return batch_totals(reports).join(F.broadcast(breaches))


def status_counts(reports: DataFrame) -> DataFrame:
    """Results per status and label, without moving rows."""
    results = F.col("results")

    def count(status):
        return F.size(F.filter(results, lambda r: r["status"] == status)).alias(status)

    counts = [count(s) for s in STATUSES]
    return reports.select(F.col("file_name").alias("File Name"), *counts,
                          overall_status(results).alias(OVERALL_FIELD))


def _by_status(status: Column, texts: dict, default) -> Column:
    first, *rest = texts.items()
    chain = F.when(status == first[0], first[1])
    chain = reduce(lambda c, kv: c.when(status == kv[0], kv[1]), rest, chain)
    return chain.otherwise(default)


def status_badge(status: Column) -> Column:
    return _by_status(status, STATUS_BADGES, status)


def reviewer_action(status: Column) -> Column:
    return _by_status(status, REVIEWER_ACTIONS, REVIEWER_ACTION_DEFAULT)


def tooltip(field: Column, expected: Column, observed: Column, message: Column,
            evidence: Column) -> Column:
    def part(label, value, default=None):
        text = strip(value)
        body = F.when(text != "", text)
        if default is not None:
            body = F.coalesce(body, F.lit(default))
        return F.concat(F.lit(label), body)  # null when blank, and then left out

    return F.concat_ws(
        " | ", F.concat(F.lit("Field: "), field),
        part("Application value: ", expected, "Not provided"),
        part("Extracted value: ", observed, "Not detected"),
        part("Explanation: ", message), part("Evidence: ", evidence))


def comparison(reports: DataFrame, with_tooltip: bool = True) -> DataFrame:
    """Side by side: the extracted field, where there is one, replaces the rule's finding."""
    fields = reports.withColumn("fields", field_map(F.col("extracted")))
    rows = detail_rows(fields, "fields")
    found = F.col("fields")[F.col("field_name")]
    seen = F.when(strip(found) != "", found).otherwise(F.col("observed"))
    table = rows.select(
        F.col("file_name").alias("File Name"), F.col("field_name").alias("Field"),
        F.col("expected").alias("Application"), seen.alias("Extracted"),
        status_badge(F.col("status")).alias("Status"), F.col("severity").alias("Severity"),
        F.round("confidence", 1).alias("Confidence"), F.col("message").alias("Explanation"),
        reviewer_action(F.col("status")).alias("Reviewer Action"),
        tooltip(F.col("field_name"), F.col("expected"), seen, F.col("message"),
                F.col("evidence")).alias("Tooltip"))
    return table if with_tooltip else table.drop("Tooltip")


def evidence_action(status: Column, review: Column) -> Column:
    """The evidence package's wording; the review flag decides first."""
    status = F.lower(status)
    return (
        F.when(review, "Review manually and confirm against source records.")
        .when(status == "pass", "No reviewer action required.")
        .when(status.isin("fail", "failed"), "Resolve mismatch or request corrected source data.")
        .when(status.isin("warning", "needs review"),
              "Review supporting evidence before clearing.")
        .otherwise("Review the result if the status is unclear."))


def evidence_comparison(reports: DataFrame) -> DataFrame:
    """Comparison as the evidence package writes it: the rule's own finding, plain status."""
    return detail_rows(reports).select(
        F.col("file_name").alias("File Name"), F.col("field_name").alias("Field"),
        F.col("expected").alias("Application"), F.col("observed").alias("Extracted"),
        F.col("status").alias("Status"), F.col("severity").alias("Severity"),
        F.col("confidence").alias("Confidence"), F.col("message").alias("Explanation"),
        evidence_action(F.col("status"), F.col("requires_human_review"))
        .alias("Reviewer Action"))


def diagnostic_status(readable: Column, notes: Column) -> Column:
    return F.when(~readable, REVIEW).when(F.size(notes) > 0, WARNING).otherwise(PASS)


def diagnostic_recommendation(readable: Column, notes: Column) -> Column:
    """First matching topic among the image-quality notes."""
    said = F.lower(F.array_join(notes, " "))
    return (
        F.when(~readable,
               "Request clearer artwork or manually review the submitted label because OCR did "
               "not return readable text.")
        .when(F.size(notes) <= 0,
              "No image-quality issues were reported by the OCR preprocessing pipeline.")
        .when(said.rlike("glare|overexposure"),
              "Review the label manually or request a new image with reduced glare and more "
              "even lighting.")
        .when(said.rlike("contrast|dark|brightness"),
              "Review the label manually or request a better-lit image with stronger text "
              "contrast.")
        .when(said.rlike("blur|sharp"),
              "Review the label manually or request a sharper image captured with better focus.")
        .when(said.rlike("skew|angle|orientation"),
              "Review the label manually or request a straighter image with less rotation or "
              "perspective distortion.")
        .when(said.rlike("small|resolution|resize"),
              "Review the label manually or request a higher-resolution image so OCR can read "
              "small text.")
        .otherwise("Review the OCR output and image-quality notes before making a final "
                   "determination."))


def diagnostics(labels: DataFrame) -> DataFrame:
    """Three fixed rows per label and one per quality note, or one saying there is none."""
    readable = has_text(F.col("raw_text"))
    notes = F.coalesce(F.col("image_quality_notes"), F.array().cast("array<string>"))
    based = labels.select(
        "file_name", "ocr_engine", "ocr_seconds", notes.alias("notes"),
        readable.alias("readable"))
    based = based.withColumns({
        "badge": status_badge(diagnostic_status(F.col("readable"), F.col("notes"))),
        "advice": diagnostic_recommendation(F.col("readable"), F.col("notes"))})

    def row(name, status, value, guidance):
        return F.struct(name.alias("Diagnostic"), status.alias("Status"),
                        value.alias("Value"), guidance.alias("Reviewer Guidance"))

    yes = F.col("readable")
    engine = F.col("ocr_engine")
    fixed = F.array(
        row(F.lit("OCR Text Found"), status_badge(F.when(yes, PASS).otherwise(REVIEW)),
            F.when(yes, "Yes").otherwise("No"), F.col("advice")),
        row(F.lit("OCR Engine"), F.col("badge"),
            F.when(F.coalesce(engine, F.lit("")) == "", "Not reported").otherwise(engine),
            F.lit("Confirm OCR output before relying on automated checks.")),
        row(F.lit("OCR Seconds"), F.col("badge"),
            F.round(F.coalesce("ocr_seconds", F.lit(0.0)), 3).cast("string"),
            F.lit("Longer timing may indicate large files or preprocessing overhead.")))
    noted = F.transform("notes", lambda note, i: row(
        F.concat(F.lit("Image Quality Note "), (i + 1).cast("string")),
        status_badge(F.lit(WARNING)), note, F.col("advice")))
    clean = F.array(row(F.lit("Image Quality Notes"), status_badge(F.lit(PASS)),
                        F.lit("No image-quality notes reported."), F.col("advice")))
    rows = F.concat(fixed, F.when(F.size("notes") > 0, noted).otherwise(clean))
    exploded = based.select("file_name", F.posexplode_outer(rows).alias("ordinal", "d"))
    return exploded.select(F.col("file_name").alias("File Name"), "ordinal", "d.*")
