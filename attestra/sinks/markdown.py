"""Markdown reports. A label's report is one value built inside its row; a batch report is a
table of lines, because a batch has no size limit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.constants import DISCLAIMER
from attestra.operators import checklists
from attestra.operators.performance import fixed
from attestra.operators.redaction import is_sensitive_column, raw_text_or_notice, redact_table, redact_value
from attestra.operators.reports import DATE_FORMAT, batch_totals, detail, overall_status, summary
from attestra.schema import RetentionOptions

_NOTICE = (
    "Raw OCR text, extracted label values, application values, local file paths, and detailed "
    "evidence text are redacted by default."
)
_FIELDS = (
    ("Field Name", "field_name"), ("Rule ID", "rule_id"), ("Status", "status"),
    ("Severity", "severity"), ("Expected", "expected"), ("Observed", "observed"),
    ("Confidence", "confidence"), ("Evidence", "evidence"), ("Message", "message"),
)


def _cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


def _row(cells) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _head(names) -> str:
    return "| " + " | ".join(names) + " |\n|" + "|".join(":---" for _ in names) + "|"


def label_markdown(reports: DataFrame,
                   options: RetentionOptions = RetentionOptions()) -> DataFrame:
    """``(file_name, markdown)`` per label; its results are already in the row."""
    def table_row(r):
        cells = [_cell(F.col("file_name"))]
        for label, name in _FIELDS:
            value = F.round(r[name], 2) if name == "confidence" else r[name]
            hide = is_sensitive_column(label, options.strict) and not options.can_export_values
            cells.append(_cell(redact_value(value) if hide else value))
        return _row(cells)

    rows = F.array_join(F.transform("results", table_row), "\n")
    body = F.when(F.size("results") > 0, F.concat(
        F.lit(_head(["File Name"] + [n for n, _ in _FIELDS]) + "\n"), rows)
    ).otherwise("No rule results were available.")
    parts = (
        F.lit("# Label Verification Report\n"),
        F.concat(F.lit("**File:** "), redact_value(F.col("file_name"))),
        F.concat(F.lit("**Overall Status:** "), overall_status(F.col("results"))),
        F.concat(F.lit("**Created On:** "), F.date_format("created_on", DATE_FORMAT)),
        F.concat(F.lit("**Processing Seconds:** "),
                 F.format_string("%.2f", F.col("processing_seconds"))),
        F.lit("\n## Application Values\n\nApplication values are redacted by the no-persistence "
              "policy.\n\n## Rule Results\n"),
        body,
        F.lit("\n## Extracted Label Text\n\n```text"),
        raw_text_or_notice(F.col("raw_text"), options),
        F.lit(f"```\n\n## Data Retention Notice\n\n{_NOTICE}\n\n## Reviewer Disclaimer\n\n"
              f"{DISCLAIMER}"),
    )
    return reports.select("file_name", F.concat_ws("\n", *parts).alias("markdown"))


def _lines(df: DataFrame, section: int, first: Column | None, line: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"),
                     (F.lit("") if first is None else first).alias("position"),
                     F.lit(0).alias("ordinal") if "ordinal" not in df.columns
                     else F.col("ordinal"), line.alias("line"))


def batch_markdown(reports: DataFrame, created_on: str,
                   options: RetentionOptions = RetentionOptions()) -> DataFrame:
    """``(section, position, ordinal, line)`` rows; write them with ``write_markdown``."""
    totals = batch_totals(reports)
    heading = totals.select(F.posexplode(F.array(
        F.lit("# Batch Verification Report"), F.lit(""),
        F.lit(f"**Created On:** {created_on}"),
        F.concat(F.lit("**Total Files:** "), F.col("total_files").cast("string")),
        F.concat(F.lit("**Files With Failures:** "), F.col("total_failures").cast("string")),
        F.concat(F.lit("**Files With Warnings:** "), F.col("total_warnings").cast("string")),
        F.concat(F.lit("**Files Requiring Review:** "), F.col("total_reviews").cast("string")),
        F.lit(""))).alias("ordinal", "text"))

    def fixed(section, text):
        rows = reports.sparkSession.range(1).select(
            F.posexplode(F.array(*[F.lit(t) for t in text.split("\n")])).alias("ordinal", "text"))
        return _lines(rows, section, None, F.col("text"))

    def table(df, section):
        safe = redact_table(df, options)
        return safe.select(
            F.lit(section).alias("section"), F.col("File Name").alias("position"),
            F.lit(0).alias("ordinal"),
            _row([_cell(F.col(f"`{c}`")) for c in safe.columns]).alias("line"))

    brief, rules = summary(reports), detail(reports)
    parts = [
        _lines(heading, 0, None, F.col("text")),
        fixed(1, "## Batch Summary\n\n" + _head(brief.columns)), table(brief, 2),
        fixed(3, "\n## Rule Details\n\n" + _head(rules.columns)), table(rules, 4),
        fixed(5, "\n## Data Retention Notice\n\n" + _NOTICE),
    ]
    return reduce(DataFrame.unionByName, parts)


def _block(rows: DataFrame, keys: list[str], section: int, position: Column, lines: list[Column]) -> DataFrame:
    """A fixed number of lines per row, behind each other."""
    return rows.select(*keys, F.lit(section).alias("section"), position.alias("position"),
                       F.posexplode(F.array(*lines)).alias("ordinal", "line"))


def _text(value: Column | str) -> Column:
    return F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(""))


def _entry(label: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{label}: "), _text(value))


def _truth(value: Column | str) -> Column:
    return F.initcap(_text(value))


def _head_only(df: DataFrame, keys: list[str], lines: list[Column]) -> DataFrame:
    return _block(df, keys, 0, F.lit(""), lines)


def timing_markdown(accepted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Lines of a performance report per row of ``timing_acceptance``, after its batch columns."""
    def seconds(label, name, digits=3):
        return _entry(label, fixed(F.col(name), digits))

    nothing = F.lit("")
    return _head_only(accepted, list(by), [
        F.lit("# Performance Summary"), nothing, _entry("Total Files", "total_files"),
        seconds("Average Seconds", "average_seconds"), seconds("Median Seconds", "median_seconds"),
        seconds("P95 Seconds", "p95_seconds"), seconds("Maximum Seconds", "maximum_seconds"),
        seconds("SLA Seconds", "sla_seconds"), _entry("SLA Breach Count", "sla_breach_count"),
        seconds("SLA Breach Rate", "sla_breach_rate", 4), nothing, F.lit("## Acceptance"), nothing,
        _entry("Status", "acceptance_status"), _entry("Meets Acceptance", _truth("meets_acceptance")),
        _entry("Message", "acceptance_message"), nothing])


def acceptance_markdown(requirements: DataFrame, rollup: DataFrame, created_on: str) -> DataFrame:
    """Lines of an acceptance report: the counts, then every requirement in its order."""
    nothing = F.lit("")
    head = _head_only(rollup, [], [
        F.lit("# Acceptance Summary"), nothing, F.lit(f"Created On: {created_on}"),
        F.concat(_entry("Acceptance Percentage", "acceptance_percentage"), F.lit("%")), nothing,
        F.lit("## Status Counts"), nothing, _entry("- Met", "met"), _entry("- Partially Met", "partially_met"),
        _entry("- Not Met", "not_met"), _entry("- Not Applicable", "not_applicable"), nothing,
        F.lit("## Requirement Results"), nothing])
    rows = _block(requirements, [], 1, F.format_string("%06d", F.col("ordinal")), [
        F.concat(F.lit("### "), _text("requirement_id"), F.lit(" - "), _text("requirement_name")), nothing,
        _entry("Status", "status"), nothing, _entry("Evidence", "evidence"), nothing,
        _entry("Recommendation", "recommendation"), nothing])
    return head.unionByName(rows)


def _item_lines(items: DataFrame, fields: tuple[tuple[str, str], ...]) -> DataFrame:
    """The entry of each checklist item; fields the table does not have are blank."""
    cells = [_entry(f"- {label}", name if name in items.columns else F.lit("")) for label, name in fields]
    title = F.concat(F.lit("### "), _text("item_id"), F.lit(" - "), _text("name"))
    return _block(items, ["checklist"], 1, _text("item_id"), [title, F.lit(""), *cells, F.lit("")])


def deployment_markdown(items: DataFrame, created_on: str) -> DataFrame:
    """Lines of a deployment report per checklist, its items by their number."""
    nothing = F.lit("")
    head = _head_only(checklists.evidence_rollup(items), ["checklist"], [
        F.lit("# Deployment Evidence"), nothing, F.lit(f"Created On: {created_on}"),
        _entry("Overall Status", "overall_status"), nothing, F.lit("## Status Counts"), nothing,
        _entry("- Met", "met"), _entry("- Partially Met", "partially_met"), _entry("- Not Met", "not_met"),
        _entry("- Not Evaluated", "not_evaluated"), nothing, F.lit("## Evidence Checks"), nothing])
    return head.unionByName(_item_lines(items, (
        ("Category", "category"), ("Status", "status"), ("Evidence", "evidence"), ("Recommendation", "recommendation"),
        ("Path", "path"), ("Evaluated On", "evaluated_on"))))


def accessibility_markdown(items: DataFrame, created_on: str, keyboard_required: bool = True,
                           high_contrast: bool = False, large_text: bool = False) -> DataFrame:
    """Lines of an accessibility report per checklist, its items by their number."""
    nothing = F.lit("")
    rolled = checklists.accessibility_rollup(items, keyboard_required, high_contrast, large_text)
    head = _head_only(rolled, ["checklist"], [
        F.lit("# Accessibility Checklist"), nothing, F.lit(f"Created On: {created_on}"),
        _entry("Accessibility Status", "overall_status"), _entry("Message", "message"), nothing,
        F.lit("## Summary"), nothing, F.lit(f"- High Contrast Available: {high_contrast}"),
        F.lit(f"- Large Text Available: {large_text}"), F.lit(f"- Keyboard Check Required: {keyboard_required}"),
        _entry("- Passed Items", "passed"), _entry("- Failed Items", "failed"), _entry("- Untested Items", "untested"),
        _entry("- Not Applicable Items", "not_applicable"), nothing, F.lit("## Checklist Items"), nothing])
    return head.unionByName(_item_lines(items, (
        ("Category", "category"), ("Status", "status"), ("Procedure", "procedure"),
        ("Expected Result", "expected_result"), ("Notes", "notes"), ("Evaluated On", "evaluated_on"))))
