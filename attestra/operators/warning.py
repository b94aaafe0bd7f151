"""Mandatory-warning validation: prefix, capitals, exact wording, similarity, visual risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.constants import (
    ANY_CASE_PREFIX_PATTERN, HIGH, MEDIUM, WARNING_FIELD, WARNING_TEXT_NORMALIZED,
)
from attestra.functions import fuzzy
from attestra.functions import text as tx
from attestra.operators.outcomes import VISUAL_LOOK, rule_result
from attestra.operators.results import review_result
from attestra.schema import RuleOptions

_INSPECT = (
    "Inspect the label artwork manually because warning text was not detected by OCR and "
    "visual formatting cannot be evaluated automatically."
)
_UNAVAILABLE = "Government warning validation could not be completed"
WARNING_RULES = (
    "government_warning_present", "government_warning_exact", "government_warning_prefix_caps",
    "government_warning_visual_format",
)


def warning_context(text: Column, window: int = 420) -> Column:
    """The text from the first prefix, in any case, for ``window`` characters."""
    pattern = rf"(?isU)({ANY_CASE_PREFIX_PATTERN}.{{0,{window}}})"
    return tx.strip(F.substring(F.regexp_extract(tx.blank(text), pattern, 1), 1, window))


def has_any_prefix(text: Column) -> Column:
    return tx.blank(text).rlike("(?iU)" + ANY_CASE_PREFIX_PATTERN)


def has_standard_text(match_text: Column) -> Column:
    return F.contains(match_text, F.lit(WARNING_TEXT_NORMALIZED))


def warning_similarity(match_text: Column) -> Column:
    return fuzzy.partial_ratio(F.lit(WARNING_TEXT_NORMALIZED), match_text)


def prefix_signals(options: RuleOptions = RuleOptions()) -> dict[str, Column]:
    """Signals that need only ``raw_text``: prefix, capitals, context."""
    text = tx.blank(F.col("raw_text"))
    return {
        "_prefix": has_any_prefix(text),
        "_caps": tx.has_caps_prefix(text),
        "_context": warning_context(text, options.warning_window),
    }


def with_warning(labels: DataFrame, options: RuleOptions = RuleOptions(),
                 notes: Column | None = None) -> DataFrame:
    """Add the outcome signals to rows with ``prefix_signals``, ``_exact``, ``_similarity``.

    The signals stay flat columns: as a struct, Catalyst would inline their regular
    expressions into every reader. ``notes`` are image-quality notes; the rule set has none.
    """
    noted = F.lit(False) if notes is None else F.coalesce(F.size(notes) > 0, F.lit(False))
    near = F.col("_similarity") >= options.near_warning_threshold
    present = F.col("_present")
    return (
        labels.withColumn("_near", ~F.col("_exact") & near)
        .withColumn("_present", F.col("_prefix") | F.col("_exact") | F.col("_near"))
        .withColumn("_visual", F.when(present & ~noted, 1).when(present, 2).otherwise(3)))


def warning_columns() -> dict[str, Column]:
    """The four warning results over a ``with_warning`` frame, in report order."""
    c = F.col
    codes = {
        "government_warning_present": F.when(c("_present"), 1).otherwise(2),
        "government_warning_exact":
            F.when(c("_exact"), 1).when(c("_near"), 2).otherwise(3),
        "government_warning_prefix_caps": F.when(c("_caps"), 1).otherwise(2),
        "government_warning_visual_format": c("_visual"),
    }
    return {rule: rule_result(rule, code, confidence=c("_similarity"), evidence=c("_context"))
            for rule, code in codes.items()}


def validation_struct() -> Column:
    """Validation outcome of one text as a struct, over a ``with_warning`` frame."""
    c = F.col
    supplied = tx.blank(c("raw_text")) != ""
    wording = (
        F.when(c("_exact"), "Standard government warning text was detected exactly.")
        .when(c("_near"), "Government warning text is similar to the standard warning but "
                          "fails the exact-text requirement and requires reviewer "
                          "confirmation.")
        .otherwise("Standard government warning text was not detected."))
    messages = F.array_compact(F.array(
        F.when(~c("_prefix"), "Government warning prefix was not detected."),
        F.when(c("_prefix") & ~c("_caps"),
               "Government warning prefix is present but is not all caps."),
        wording,
        F.lit("OCR text checks cannot verify boldness, readable size, contrast, prominence, "
              "or whether the warning is visually hidden; reviewer visual confirmation is "
              "required."),
    ))
    return F.struct(
        c("_present").alias("text_present"),
        c("_prefix").alias("prefix_present"),
        c("_caps").alias("prefix_all_caps"),
        c("_exact").alias("exact_text_match"),
        c("_near").alias("near_text_match"),
        F.when(supplied, c("_similarity")).otherwise(0.0).alias("normalized_similarity"),
        F.lit(False).alias("visual_format_verified"),
        F.lit(True).alias("visual_format_review_required"),
        F.when(supplied & (c("_visual") == 1), MEDIUM).otherwise(HIGH).alias("risk_level"),
        F.when(~supplied, _UNAVAILABLE + "; review manually.")
        .when(c("_present"), VISUAL_LOOK).otherwise(_INSPECT).alias("reviewer_instruction"),
        c("_context").alias("warning_context"),
        F.when(supplied, messages).otherwise(F.array(F.lit(_UNAVAILABLE + ".")))
        .alias("messages"),
    )


def unavailable_result(
        rule_id: str = "government_warning_validation_unavailable",
        message: str = "Government warning validation results could not be created.") -> Column:
    return review_result(
        rule_id, WARNING_FIELD, "Executable government-warning validation",
        "Government-warning validation unavailable", message)


def validate_warnings(texts: DataFrame, text: str = "raw_text", notes: str | None = None,
                      options: RuleOptions = RuleOptions()) -> DataFrame:
    """Stand-alone check of any text table: adds ``warning`` and ``warning_results``."""
    source = texts if text == "raw_text" else texts.withColumn("raw_text", F.col(text))
    match = source.withColumn(
        "_match", tx.match_folded(tx.fold_ascii(F.col("raw_text"), pinned=True)))
    scored = match.withColumns(prefix_signals(options)).withColumn("_exact", has_standard_text(F.col("_match"))).withColumn(
        "_similarity", F.when(F.col("_match") == "", 0.0).otherwise(
            warning_similarity(F.col("_match"))))
    flagged = with_warning(scored, options, None if notes is None else F.col(notes))
    all_four = F.array(*warning_columns().values())
    done = flagged.withColumns({
        "warning": validation_struct(),
        "warning_results": F.when(tx.blank(F.col("raw_text")) == "",
                                  F.array(unavailable_result())).otherwise(all_four),
    })
    return done.select(*texts.columns, "warning", "warning_results")
