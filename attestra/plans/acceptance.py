"""The acceptance run: batch, requirements, verdict and evidence package."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators import evidence
from attestra.operators.redaction import policy_flags, redact_nested
from attestra.plans.batch import BatchTables, run_manifest_batch
from attestra.schema import RetentionOptions, SlaOptions
from attestra.sinks import markdown
from attestra.sinks.writers import write_outputs


@dataclass(frozen=True)
class AcceptanceRun:
    batch: BatchTables
    requirements: DataFrame
    rollup: DataFrame
    verdict: DataFrame


def evaluate(batch: BatchTables, flags: dict | None = None, sla: SlaOptions = SlaOptions(),
             retention: RetentionOptions = RetentionOptions()) -> AcceptanceRun:
    """Requirement rows, roll-up and verdict of a finished batch."""
    spark = batch.reports.sparkSession
    counts = batch.validation.select(
        F.size("errors").alias("errors"), F.size("warnings").alias("notices"))
    processed = batch.reports.agg(F.coalesce(
        F.sum(F.when(F.col("processed"), F.col("occurrences"))), F.lit(0)).alias("done"))
    skipped = batch.skipped.agg(F.count("*").alias("left_out"))
    extra = batch.warnings.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("raised"))
    facts = evidence.run_facts(batch.reports, processed=0, performance=batch.timing)
    one = facts
    for part in (counts, processed, skipped, extra):
        one = one.join(F.broadcast(part))  # one row each
    one = one.withColumns({
        "processed_count": F.col("done"), "skipped_count": F.col("left_out"),
        "error_count": F.col("errors").cast("bigint"),
        "warning_count": (F.col("notices") + F.col("raised")).cast("bigint"),
    }).drop("errors", "notices", "done", "left_out", "raised")
    known = {**policy_flags(retention), "ACCEPTANCE_EXPORT_AVAILABLE": True,
             "PROGRESS_INDICATORS_DISPLAYED": True,
             "NON_HOVER_MISMATCH_GUIDANCE_DISPLAYED": True,
             "BATCH_ACCEPTANCE_MIN_FILES": sla.min_files,
             "BATCH_ACCEPTANCE_MAX_FILES": sla.max_files, **(flags or {})}
    table = evidence.requirements(one, evidence.flags_table(spark, known))
    rollup = evidence.requirement_rollup(table)
    verdict = rollup.join(F.broadcast(counts)).select(
        evidence.run_verdict(F.col("errors"), F.col("met"), F.col("partially_met"),
                             F.col("not_met"), F.lit(0)).alias("status"),
        "errors", "met", "partially_met", "not_met", "not_applicable", "acceptance_percentage")
    return AcceptanceRun(batch, table, rollup, verdict)


def run_acceptance(manifest: DataFrame, texts: DataFrame, store: str,
                   flags: dict | None = None, sla: SlaOptions = SlaOptions(),
                   retention: RetentionOptions = RetentionOptions(), accessibility: DataFrame | None = None,
                   deployment: DataFrame | None = None, created_on: str = "") -> AcceptanceRun:
    """Verify, judge and write the evidence package below ``store``, a shared folder.

    ``accessibility`` and ``deployment`` are checklist tables (``checklist, item_id, name, status``
    and more); their tables and reports join the package if they are given.
    """
    batch = run_manifest_batch(manifest, texts, store, sla=sla)
    run = evaluate(batch, flags, sla, retention)
    tables = {
        "summary": batch.summary, "details": batch.details, "comparison": batch.comparison,
        "performance": batch.performance, "batch_acceptance": batch.batch_acceptance,
        "acceptance": redact_nested(run.requirements, retention).withColumn(
            "metrics", F.to_json("metrics")),
    }
    lines = {"acceptance": markdown.acceptance_markdown(run.requirements, run.rollup, created_on)}
    if accessibility is not None:
        tables["accessibility"] = accessibility
        lines["accessibility"] = markdown.accessibility_markdown(accessibility, created_on)
    if deployment is not None:
        tables["deployment"] = deployment
        lines["deployment"] = markdown.deployment_markdown(deployment, created_on)
    write_outputs(tables, lines, f"{store}/package", retention, as_json=("acceptance", "accessibility", "deployment"))
    return run
