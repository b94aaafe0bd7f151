"""Requirement statuses from run facts and posture flags, and their roll-ups.

Facts and flags are one-row tables, so a gate is a ``when`` chain over one row and the
requirement table is that row exploded. Requirement names, evidence and
recommendation texts are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.constants import (
    FAIL, MET, NOT_APPLICABLE, NOT_EVALUATED, NOT_MET, PARTIALLY_MET, PASS, REVIEW, WARNING,
)
from attestra.functions.extract import has_structured_field
from attestra.functions.text import has_text
from attestra.operators.reports import overall_status

# Flag names and what they are when nothing is known.
DEFAULT_FLAGS = {
    "ACCEPTANCE_EXPORT_AVAILABLE": False,
    "IMPERFECT_IMAGE_TESTED": False,
    "LOW_QUALITY_IMAGE_TESTED": False,
    "FALSE_POSITIVE_VARIATION_TESTED": False,
    "PERFORMANCE_SLA_TESTED": False,
    "PERFORMANCE_SLA_PASSED": False,
    "BATCH_ACCEPTANCE_MIN_FILES": 20,
    "BATCH_ACCEPTANCE_MAX_FILES": 50,
    "REQUIRE_LOCAL_OCR": True,
    "ALLOW_EXTERNAL_ML_ENDPOINTS": False,
    "NO_PERSISTENCE_MODE": True,
    "LONG_TERM_STORAGE_DISABLED": True,
    "ENABLE_UPLOAD_PERSISTENCE": False,
    "ENABLE_RAW_TEXT_LOGGING": False,
    "ENABLE_RAW_OCR_EXPORT": False,
    "ENABLE_EXTRACTED_DATA_EXPORT": False,
    "ENABLE_REDACTED_EVIDENCE_EXPORT": True,
    "ENABLE_FILE_PATH_EXPORT": False,
    "DEFAULT_SIMPLE_MODE": True,
    "DEFAULT_HIGH_CONTRAST_MODE": False,
    "DEFAULT_LARGE_TEXT_MODE": False,
    "HIGH_CONTRAST_AVAILABLE": True,
    "LARGE_TEXT_AVAILABLE": True,
    "KEYBOARD_ACCESSIBILITY_PASSED": False,
    "LOW_TECH_REVIEWER_WORKFLOW_VALIDATED": False,
    "LARGE_BUTTONS_PRESENT": True,
    "MINIMAL_NAVIGATION_VALIDATED": False,
    "PROGRESS_INDICATORS_DISPLAYED": False,
    "NON_HOVER_MISMATCH_GUIDANCE_DISPLAYED": False,
    "DEPLOYMENT_TARGET": "local",
    "AZURE_READY_ARTIFACTS_PRESENT": False,
    "AZURE_SMOKE_TEST_PASSED": False,
    "COLA_INTEGRATION_ENABLED": False,
}
COMPARISON_COLUMNS = (
    "File Name", "Field", "Application", "Extracted", "Status", "Severity", "Confidence",
    "Explanation", "Reviewer Action",
)


def flags_table(spark: SparkSession, overrides: dict | None = None) -> DataFrame:
    """One row of flags; unknown names are refused."""
    unknown = set(overrides or {}) - set(DEFAULT_FLAGS)
    if unknown:
        raise ValueError(f"Unknown evidence flags: {sorted(unknown)}")
    values = {**DEFAULT_FLAGS, **(overrides or {})}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def report_facts(reports: DataFrame) -> DataFrame:
    """One row of counts over verified labels (``extracted`` and ``results`` columns)."""
    weight = F.col("occurrences") if "occurrences" in reports.columns else F.lit(1)

    def count(condition):
        return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("bigint")

    def seen(*rule_ids):
        return F.coalesce(F.bool_or(F.exists(
            "results", lambda r: r["rule_id"].isin(*rule_ids))), F.lit(False))

    status = overall_status(F.col("results"))
    return reports.agg(
        count(F.lit(True)).alias("total_reports"),
        count(has_text(F.col("raw_text"))).alias("ocr_text_count"),
        count(has_structured_field(F.col("extracted"))).alias("structured_count"),
        count(F.size("results") > 0).alias("rule_report_count"),
        count(status.isin(FAIL, WARNING, REVIEW)).alias("review_or_failure_count"),
        seen("brand_name_match", "class_type_match").alias("has_fuzzy_rules"),
        seen("government_warning_exact").alias("has_exact_rule"),
        seen("government_warning_visual_format").alias("has_visual_rule"))


def run_facts(reports: DataFrame, *, processed: Column | int, skipped: Column | int = 0,
              errors: Column | int = 0, warnings: Column | int = 0,
              performance: DataFrame | None = None, has_summary: bool | None = None,
              has_detail: bool | None = None, has_comparison: bool | None = None,
              has_performance: bool | None = None,
              comparison_columns=COMPARISON_COLUMNS, detail_columns=("Confidence",)
              ) -> DataFrame:
    """Report facts, batch counts, timing verdict and output presence in one row.

    Whether an output has rows follows from the counts unless it is stated.
    """
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    facts = report_facts(reports)
    if performance is None:
        facts = facts.withColumns({
            "timed_files": F.lit(0).cast("bigint"), "meets_acceptance": F.lit(False),
            "acceptance_message": F.lit(
                "No timed label files were available for performance acceptance.")})
    else:
        timing = performance.select(
            F.col("total_files").alias("timed_files"), "meets_acceptance", "acceptance_message")
        facts = facts.join(F.broadcast(timing))  # one row each
    have = F.col("rule_report_count") > 0

    def stated(value, derived):
        return derived if value is None else F.lit(value)

    return facts.withColumns({
        "processed_count": col(processed).cast("bigint"),
        "skipped_count": col(skipped).cast("bigint"),
        "error_count": col(errors).cast("bigint"),
        "warning_count": col(warnings).cast("bigint"),
        "has_summary": stated(has_summary, F.col("total_reports") > 0),
        "has_detail": stated(has_detail, have),
        "has_comparison": stated(has_comparison, have),
        "has_performance": stated(has_performance, F.col("timed_files") > 0),
        "has_required_columns":
            F.lit(set(COMPARISON_COLUMNS) <= set(comparison_columns)) & have,
        "has_reviewer_action": F.lit("Reviewer Action" in comparison_columns),
        "has_confidence": F.lit("Confidence" in comparison_columns
                                or "Confidence" in detail_columns),
    })


def _text(value: Column) -> Column:
    return value.cast("string")


def _flag(value: Column) -> Column:
    return F.when(value, "True").otherwise("False")


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _requirement(ordinal, number, name, status, evidence, recommendation, **metrics) -> Column:
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    pairs = [x for k, v in metrics.items() for x in (F.lit(k), lit(v).cast("string"))]
    return F.struct(
        F.lit(ordinal).alias("ordinal"), F.lit(number).alias("requirement_id"),
        F.lit(name).alias("requirement_name"), lit(status).alias("status"),
        lit(evidence).alias("evidence"), lit(recommendation).alias("recommendation"),
        F.create_map(*pairs).alias("metrics"))


def _run_requirements() -> list[Column]:
    c = F.col
    reports, ruled = c("total_reports"), c("rule_report_count")
    extracted = (reports > 0) & (c("ocr_text_count") > 0) & (c("structured_count") > 0)
    covered = (c("has_required_columns") & c("has_fuzzy_rules") & c("has_exact_rule")
               & c("has_visual_rule"))
    ran = (reports > 0) & (ruled > 0)
    processed = c("processed_count")
    many, one = (reports > 1) & (processed > 1), (reports == 1) | (processed == 1)
    told = c("PERFORMANCE_SLA_TESTED") & c("PERFORMANCE_SLA_PASSED")
    timed = (c("timed_files") > 0) | c("PERFORMANCE_SLA_TESTED")
    core = c("has_summary") & c("has_detail") & c("has_comparison")
    full = core & c("has_performance") & c("ACCEPTANCE_EXPORT_AVAILABLE")
    clean = (reports > 0) & (c("error_count") == 0)
    effective = F.greatest(processed, reports)
    low, high = c("BATCH_ACCEPTANCE_MIN_FILES"), c("BATCH_ACCEPTANCE_MAX_FILES")
    within = (effective >= low) & (effective <= high)
    span = _say(_text(low), "–", _text(high))
    return [
        _requirement(
            1, "1.1", "Label Data Extraction", F.when(extracted, MET).otherwise(NOT_MET),
            F.when(extracted, _say(
                "OCR text was produced for ", _text(c("ocr_text_count")),
                " reports and structured fields were produced for ",
                _text(c("structured_count")), " reports."))
            .otherwise(_say("Total reports: ", _text(reports), "; OCR text count: ",
                            _text(c("ocr_text_count")), "; structured-field report count: ",
                            _text(c("structured_count")), ".")),
            F.when(extracted, "Retain extraction and visual-quality outputs.")
            .otherwise("Correct OCR, preprocessing, or field extraction."),
            total_reports=reports, ocr_text_count=c("ocr_text_count"),
            structured_field_report_count=c("structured_count"),
            imperfect_image_evidence=c("IMPERFECT_IMAGE_TESTED")),
        _requirement(
            2, "1.2", "Application vs. Label Comparison",
            F.when(ran & covered, MET).when(ran, PARTIALLY_MET).otherwise(NOT_MET),
            F.when(ran & covered, "Comparison output, fuzzy rules, exact warning rule, and "
                                  "visual warning rule are present.")
            .when(ran, _say(
                "Rule results exist, but required columns or expected rule coverage are "
                "incomplete. Required columns present: ", _flag(c("has_required_columns")),
                "; fuzzy rules: ", _flag(c("has_fuzzy_rules")), "; exact warning rule: ",
                _flag(c("has_exact_rule")), "; visual warning rule: ",
                _flag(c("has_visual_rule")), "."))
            .otherwise("No usable application-versus-label rule comparison evidence was found."),
            F.when(ran & covered, "Retain redacted comparison output.")
            .when(ran, "Complete comparison schema and rule coverage.")
            .otherwise("Correct label verifier and comparison output generation."),
            total_reports=reports, rule_report_count=ruled,
            has_required_columns=c("has_required_columns"),
            has_fuzzy_rules=c("has_fuzzy_rules"),
            has_government_warning_exact_rule=c("has_exact_rule"),
            has_government_warning_visual_rule=c("has_visual_rule")),
        _requirement(
            3, "1.3", "Batch Processing",
            F.when(many, MET).when(one, PARTIALLY_MET).otherwise(NOT_MET),
            F.when(many, _say("Batch run produced ", _text(reports), " reports and ",
                              _text(processed), " processed files."))
            .when(one, "One label was processed; batch capability was not fully exercised.")
            .otherwise("No batch-processing reports were produced."),
            F.when(many, "Retain batch summary output.")
            .when(one, "Run a multi-label manifest or ZIP upload.")
            .otherwise("Correct manifest/file matching and batch execution."),
            report_count=reports, processed_count=processed, skipped_count=c("skipped_count")),
        _requirement(
            4, "1.4", "Performance Under Five Seconds Per Label",
            F.when(c("meets_acceptance") | told, MET).otherwise(NOT_MET),
            F.when(c("meets_acceptance"), c("acceptance_message"))
            .when(told, "Supplemental performance evidence indicates the five-second SLA passed.")
            .when(timed, c("acceptance_message"))
            .otherwise("No timed performance results were supplied."),
            F.when(c("meets_acceptance") | told, "Retain performance output.")
            .when(timed, "Implement hard deadline behavior or optimize OCR path.")
            .otherwise("Run verification with performance monitoring enabled."),
            total_files=c("timed_files"), performance_sla_tested=c("PERFORMANCE_SLA_TESTED"),
            performance_sla_passed=c("PERFORMANCE_SLA_PASSED")),
        _requirement(
            5, "1.5", "Output and Downloads",
            F.when(full, MET).when(core, PARTIALLY_MET).otherwise(NOT_MET),
            F.when(full, "Summary, detail, comparison, performance, and acceptance outputs are "
                         "available.")
            .when(core, "Core outputs are available, but performance or acceptance output is "
                        "missing.").otherwise("Required reviewer outputs are incomplete."),
            F.when(full, "Retain redacted outputs.")
            .when(core, "Wire performance and acceptance outputs.")
            .otherwise("Correct report generation and download preparation."),
            has_summary=c("has_summary"), has_detail=c("has_detail"),
            has_comparison=c("has_comparison"), has_performance=c("has_performance"),
            has_acceptance_export=c("ACCEPTANCE_EXPORT_AVAILABLE")),
        _requirement(
            7, "2.2", "Reliability and Graceful Error Handling",
            F.when(clean, MET).when(reports > 0, PARTIALLY_MET).otherwise(NOT_MET),
            F.when(clean, _say("Run produced ", _text(reports), " reports with ",
                               _text(c("warning_count")), " warnings and ",
                               _text(c("skipped_count")), " skipped files."))
            .when(reports > 0, _say("Run produced reports but also had ",
                                    _text(c("error_count")), " batch-level errors."))
            .otherwise("No completed reports were available."),
            F.when(clean, "Retain warning/review outputs.")
            .when(reports > 0, "Correct batch-level errors.")
            .otherwise("Correct processing failures."),
            report_count=reports, error_count=c("error_count"),
            warning_count=c("warning_count"), skipped_count=c("skipped_count"),
            low_quality_image_tested=c("LOW_QUALITY_IMAGE_TESTED"),
            false_positive_variation_tested=c("FALSE_POSITIVE_VARIATION_TESTED")),
        _requirement(
            9, "2.4", "Prototype Scalability",
            F.when(within, MET).when(effective > 0, PARTIALLY_MET).otherwise(NOT_MET),
            F.when(within, _say("Processed/report count ", _text(effective),
                                " is within required ", span, " range."))
            .when(effective > 0, _say("Processed/report count is ", _text(effective),
                                      "; required range is ", span, "."))
            .otherwise("No processed-label count was available."),
            F.when(within, "Retain batch summary and performance outputs.")
            .when(effective > 0, "Run a representative 20–50 label batch.")
            .otherwise("Run manifest-driven batch verification."),
            effective_count=effective, minimum_files=low, maximum_files=high),
    ]


def _posture_requirements() -> list[Column]:
    c = F.col
    local, external = c("REQUIRE_LOCAL_OCR"), c("ALLOW_EXTERNAL_ML_ENDPOINTS")
    logging, quiet = c("ENABLE_RAW_TEXT_LOGGING"), c("NO_PERSISTENCE_MODE")
    storage, uploads = c("LONG_TERM_STORAGE_DISABLED"), c("ENABLE_UPLOAD_PERSISTENCE")
    raw, data = c("ENABLE_RAW_OCR_EXPORT"), c("ENABLE_EXTRACTED_DATA_EXPORT")
    redacted, paths = c("ENABLE_REDACTED_EVIDENCE_EXPORT"), c("ENABLE_FILE_PATH_EXPORT")
    secure = local & ~external & ~logging & quiet & redacted
    handled = (quiet & storage & ~uploads & ~logging & ~raw & ~data & ~paths & redacted)
    simple, buttons = c("DEFAULT_SIMPLE_MODE"), c("LARGE_BUTTONS_PRESENT")
    contrast, large = c("DEFAULT_HIGH_CONTRAST_MODE"), c("DEFAULT_LARGE_TEXT_MODE")
    keyboard = c("KEYBOARD_ACCESSIBILITY_PASSED")
    workflow = c("LOW_TECH_REVIEWER_WORKFLOW_VALIDATED")
    usable = ((contrast | c("HIGH_CONTRAST_AVAILABLE")) & (large | c("LARGE_TEXT_AVAILABLE"))
              & keyboard)
    progress = (c("timed_files") > 0) | c("PROGRESS_INDICATORS_DISPLAYED")
    guided = c("has_reviewer_action") | c("NON_HOVER_MISMATCH_GUIDANCE_DISPLAYED")
    target, ready = c("DEPLOYMENT_TARGET"), c("AZURE_READY_ARTIFACTS_PRESENT")
    smoke, cola = c("AZURE_SMOKE_TEST_PASSED"), c("COLA_INTEGRATION_ENABLED")
    closed = local & ~external
    hosted = closed & (((F.lower(target) == "azure") & ready) | smoke)

    def met(condition, otherwise):
        return F.when(condition, MET).otherwise(otherwise)

    return [
        _requirement(
            6, "2.1", "Simple Low-Technical-Comfort Usability", met(simple, PARTIALLY_MET),
            _say("Default Simple Mode: ", _flag(simple), "; workflow validated: ",
                 _flag(workflow), "."),
            "Keep Simple Mode as the default reviewer workflow.",
            default_simple_mode=simple, workflow_validated=workflow),
        _requirement(
            8, "2.3", "Security and Firewall-Safe Prototype Posture", met(secure, NOT_MET),
            _say("Local OCR required: ", _flag(local), "; external ML endpoints allowed: ",
                 _flag(external), "; raw text logging enabled: ", _flag(logging),
                 "; no-persistence mode: ", _flag(quiet), "; redacted export enabled: ",
                 _flag(redacted), "."),
            "Keep local OCR required, external ML disabled, no-persistence active, and redacted "
            "export enabled.",
            require_local_ocr=local, allow_external_ml_endpoints=external,
            enable_raw_text_logging=logging, no_persistence_mode=quiet,
            enable_redacted_evidence_export=redacted),
        _requirement(
            10, "3.1", "Interface Simplicity", met(buttons & simple, PARTIALLY_MET),
            _say("Large buttons present: ", _flag(buttons), "; Simple Mode default: ",
                 _flag(simple), "."),
            "Keep technical diagnostics out of Simple Mode.",
            large_buttons_present=buttons,
            minimal_navigation_validated=c("MINIMAL_NAVIGATION_VALIDATED"),
            default_simple_mode=simple),
        _requirement(
            11, "3.2", "Accessibility", met(usable, PARTIALLY_MET),
            _say("High contrast default: ", _flag(contrast), "; large text default: ",
                 _flag(large), "; keyboard validation passed: ", _flag(keyboard), "."),
            "Run and retain the browser keyboard accessibility checklist.",
            default_high_contrast=contrast, default_large_text=large,
            keyboard_accessibility_passed=keyboard),
        _requirement(
            12, "3.3", "Reviewer Feedback, Progress, Confidence, and Mismatch Guidance",
            met(progress & c("has_confidence") & guided, PARTIALLY_MET),
            _say("Progress evidence: ", _flag(progress), "; confidence evidence: ",
                 _flag(c("has_confidence")), "; non-hover guidance: ", _flag(guided), "."),
            "Keep visible explanation and reviewer-action columns in results.",
            has_progress_evidence=progress, has_confidence_evidence=c("has_confidence"),
            has_non_hover_mismatch_guidance=guided,
            has_reviewer_action_column=c("has_reviewer_action")),
        _requirement(
            13, "4.1", "Azure Infrastructure and Local OCR Deployment Posture",
            F.when(hosted, MET).when(closed & ready, PARTIALLY_MET).otherwise(NOT_MET),
            _say("Deployment target: ", target, "; Azure artifacts present: ", _flag(ready),
                 "; Azure smoke test passed: ", _flag(smoke), "; local OCR required: ",
                 _flag(local), "; external ML endpoints allowed: ", _flag(external), "."),
            "Add Azure runtime artifacts and keep external ML endpoints disabled.",
            deployment_target=target, azure_ready_artifacts_present=ready,
            azure_smoke_test_passed=smoke, require_local_ocr=local,
            allow_external_ml_endpoints=external),
        _requirement(
            14, "4.2", "No Direct COLA Integration", met(~cola, NOT_MET),
            _say("Direct COLA integration enabled: ", _flag(cola), "."),
            "Keep COLA integration disabled for prototype scope.",
            cola_integration_enabled=cola),
        _requirement(
            15, "4.3", "No Long-Term Storage of Images or Extracted Data",
            met(handled, NOT_MET),
            _say("No-persistence mode: ", _flag(quiet), "; long-term storage disabled: ",
                 _flag(storage), "; upload persistence enabled: ", _flag(uploads),
                 "; raw OCR export enabled: ", _flag(raw),
                 "; extracted data export enabled: ", _flag(data),
                 "; file path export enabled: ", _flag(paths),
                 "; redacted export enabled: ", _flag(redacted), "."),
            "Keep upload persistence, raw OCR export, extracted-data export, and file-path "
            "export disabled.",
            no_persistence_mode=quiet, long_term_storage_disabled=storage,
            enable_upload_persistence=uploads, enable_raw_text_logging=logging,
            enable_raw_ocr_export=raw, enable_extracted_data_export=data,
            enable_file_path_export=paths, enable_redacted_evidence_export=redacted),
    ]


def requirements(facts: DataFrame, flags: DataFrame) -> DataFrame:
    """The fifteen requirement rows of one run, in their fixed order."""
    one = facts.join(F.broadcast(flags))  # one row each
    rows = F.array(*_run_requirements(), *_posture_requirements())
    return one.select(F.explode_outer(rows).alias("r")).select("r.*").orderBy("ordinal")


def requirement_rollup(table: DataFrame) -> DataFrame:
    """Counts per status and the share of applicable requirements that are met."""
    status = F.col("status")
    counted = table.agg(
        F.count_if(status == MET).alias("met"),
        F.count_if(status == PARTIALLY_MET).alias("partially_met"),
        F.count_if(status == NOT_MET).alias("not_met"),
        F.count_if(status == NOT_APPLICABLE).alias("not_applicable"),
        F.count_if(status != NOT_APPLICABLE).alias("applicable"))
    share = F.round(F.col("met") / F.col("applicable") * 100.0, 2)
    return counted.select(
        "met", "partially_met", "not_met", "not_applicable",
        F.when(F.col("applicable") > 0, share).otherwise(0.0).alias("acceptance_percentage"))


def run_verdict(errors: Column, met: Column, partial: Column, not_met: Column,
                not_evaluated: Column) -> Column:
    """Overall verdict of a run from its error count and requirement counts."""
    return (
        F.when((errors > 0) | (not_met > 0), FAIL)
        .when((partial > 0) | (not_evaluated > 0), "Partial")
        .when(met > 0, PASS).otherwise(NOT_EVALUATED))
