"""Roll-ups of checklist tables ``(checklist, item_id, name, status, ...)``.

A checklist may have any number of items: the roll-ups are counting aggregations, and item
names per status stay rows instead of being gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.constants import (
    FAIL, MET, NOT_APPLICABLE, NOT_EVALUATED, NOT_MET, NOT_TESTED, PARTIALLY_MET, PASS,
)

ITEM_STATUSES = (PASS, FAIL, NOT_TESTED, NOT_APPLICABLE)

# Check numbers of the deployment checklist.
AZURE_ARTIFACTS = "DEPLOY-002"
LOCAL_OCR = "DEPLOY-003"
EXTERNAL_ML_OFF = "DEPLOY-004"
COLA_OFF = "DEPLOY-005"
UPLOADS_OFF = "DEPLOY-006"
TEXT_LOGGING_OFF = "DEPLOY-007"
AZURE_SMOKE = "DEPLOY-009"


def evidence_rollup(items: DataFrame) -> DataFrame:
    """Met / Partially Met / Not Met / Not Evaluated items per checklist and the overall."""
    status = F.col("status")
    counted = items.groupBy("checklist").agg(
        F.count("*").alias("items"),
        F.count_if(status == MET).alias("met"),
        F.count_if(status == PARTIALLY_MET).alias("partially_met"),
        F.count_if(status == NOT_MET).alias("not_met"),
        F.count_if(status == NOT_EVALUATED).alias("not_evaluated"))
    c = F.col
    return counted.withColumn(
        "overall_status",
        F.when(c("items") == 0, NOT_EVALUATED).when(c("not_met") > 0, NOT_MET)
        .when((c("partially_met") > 0) | (c("not_evaluated") > 0), PARTIALLY_MET)
        .otherwise(MET))


def accessibility_rollup(items: DataFrame, keyboard_required: bool = True,
                         high_contrast: bool = False, large_text: bool = False) -> DataFrame:
    """Pass / Fail / Not Tested / Not Applicable items per checklist, status and message."""
    status, c = F.col("status"), F.col
    counted = items.groupBy("checklist").agg(
        F.count_if(status == PASS).alias("passed"), F.count_if(status == FAIL).alias("failed"),
        F.count_if(status == NOT_TESTED).alias("untested"),
        F.count_if(status == NOT_APPLICABLE).alias("not_applicable"))
    open_items = (c("untested") > 0) & F.lit(keyboard_required)
    equipped = F.lit(high_contrast and large_text)
    return counted.withColumns({
        "overall_status": F.when(c("failed") > 0, NOT_MET).when(open_items, PARTIALLY_MET)
        .when(~equipped, PARTIALLY_MET).otherwise(MET),
        "message": F.when(c("failed") > 0, F.concat(
            c("failed").cast("string"),
            F.lit(" accessibility checklist item(s) failed and require remediation before "
                  "acceptance.")))
        .when(open_items, F.concat(
            c("untested").cast("string"),
            F.lit(" accessibility checklist item(s) remain untested. Manual browser validation "
                  "is required.")))
        .when(~equipped, "Checklist items are complete, but high-contrast or large-text "
                         "availability was not confirmed.")
        .otherwise("All applicable accessibility checklist items passed."),
    })


def items_with_status(items: DataFrame, status: str) -> DataFrame:
    return items.where(F.col("status") == status).select("checklist", "name")


def apply_status_overrides(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace status and notes of the items an override table names by ``item_id``.

    Overrides with a status outside the four known ones change nothing. Of several for an item
    the one with the greatest ``position`` holds, if the table has that column; else, and among
    equals, the greatest status, then the greatest notes.
    """
    ranked = ["position"] if "position" in overrides.columns else []
    known = overrides.where(F.col("status").isin(*ITEM_STATUSES)).select(
        "item_id", F.struct(*ranked, F.col("status").alias("new_status"),
                            F.coalesce(F.col("notes"), F.lit("")).alias("new_notes")).alias("new"))
    known = known.groupBy("item_id").agg(F.max("new").alias("new")).select(
        "item_id", "new.new_status", "new.new_notes")
    joined = items.join(known, "item_id", "left")
    hit = F.col("new_status").isNotNull()
    return joined.withColumns({
        "status": F.coalesce("new_status", "status"),
        "notes": F.when(hit, F.col("new_notes")).otherwise(F.col("notes")),
    }).select(*items.columns)


def deployment_flags(items: DataFrame) -> DataFrame:
    """Posture flags per checklist from its check statuses."""
    def met(check, *statuses):
        return F.coalesce(F.bool_or(
            (F.col("item_id") == check) & F.col("status").isin(*(statuses or (MET,)))),
            F.lit(False))

    return items.groupBy("checklist").agg(
        met(AZURE_ARTIFACTS, MET, PARTIALLY_MET).alias("AZURE_READY_ARTIFACTS_PRESENT"),
        met(AZURE_SMOKE).alias("AZURE_SMOKE_TEST_PASSED"),
        met(LOCAL_OCR).alias("REQUIRE_LOCAL_OCR"),
        (~met(EXTERNAL_ML_OFF)).alias("ALLOW_EXTERNAL_ML_ENDPOINTS"),
        (~met(COLA_OFF)).alias("COLA_INTEGRATION_ENABLED"),
        (~met(UPLOADS_OFF)).alias("ENABLE_UPLOAD_PERSISTENCE"),
        (~met(TEXT_LOGGING_OFF)).alias("ENABLE_RAW_TEXT_LOGGING"),
        met(UPLOADS_OFF).alias("LONG_TERM_STORAGE_DISABLED"))
