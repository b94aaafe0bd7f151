"""The rule-result struct and the fixed results that need no rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.constants import HIGH, REVIEW, TEXT_FIELD
from attestra.functions.sanitize import sanitize_text


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def review_result(rule_id: str, field_name: str, expected: str, observed: str, message,
                  evidence="") -> Column:
    """A result that is always a high-severity review with no confidence."""
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(field_name).alias("field_name"),
        F.lit(REVIEW).alias("status"),
        F.lit(HIGH).alias("severity"),
        F.lit(expected).alias("expected"),
        F.lit(observed).alias("observed"),
        F.lit(0.0).alias("confidence"),
        _col(evidence).alias("evidence"),
        _col(message).alias("message"),
        F.lit(True).alias("requires_human_review"),
    )


def unreadable_text_result(notes: Column) -> Column:
    return review_result(
        "ocr_text_extraction", TEXT_FIELD, "Readable label text from uploaded artwork",
        "No readable OCR text was extracted",
        "The uploaded label could not be read reliably by OCR. The label should be reviewed "
        "manually or resubmitted with clearer artwork.",
        F.coalesce(F.concat_ws("; ", notes), F.lit("")))


def batch_error_result(message) -> Column:
    text = sanitize_text(_col(message), 300)
    return review_result("batch_processing_error", "Batch Processing",
                   "Processable manifest row and uploaded label file",
                   "Batch processing did not complete normally", text, text)


def missing_file_result() -> Column:
    return batch_error_result(
        "Manifest row did not have a matching uploaded label file. Human review required.")


def verification_unavailable_result() -> Column:
    return review_result("verification_unavailable", "Verification",
                   "Readable label and application data",
                   "Verification could not be completed",
                   "The label could not be verified and requires human review.")


def verification_exception_result(evidence) -> Column:
    return review_result("verification_exception", "Verification",
                   "Readable label and application data",
                   "Verification could not be completed",
                   "The label could not be verified and requires human review.", evidence)


def rules_unavailable_result() -> Column:
    return review_result("verification_rules_unavailable", "Verification Rules",
                   "Executable alcohol-label rule set", "Rule execution failed",
                   "The rule engine could not complete verification.")
