import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import checklists, evidence, performance, quality, redaction
from attestra.operators import reports as rp
from attestra.schema import RetentionOptions, SlaOptions


def timings(spark, values):
    return spark.createDataFrame([(f"f{i}", float(v)) for i, v in enumerate(values)], "file_name string, processing_seconds double")


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0, 10.0], [-1.0, 4.0], list(np.linspace(0.1, 7, 43))])
def test_summary_equals_numpy(spark, values):
    row = performance.timing_summary(timings(spark, values)).first()
    clean = np.maximum(values, 0)
    assert row["average_seconds"] == pytest.approx(clean.mean())
    for name, q in (("median_seconds", 50), ("p90_seconds", 90), ("p95_seconds", 95)):
        assert row[name] == pytest.approx(np.percentile(clean, q))
    assert row["sla_breach_count"] == (clean > 5).sum()


def test_weights_repeat_timings(spark):
    df = spark.createDataFrame([(1.0, 3), (9.0, 1)], "processing_seconds double, n long")
    got = performance.timing_summary(df, weight="n").first()
    want = performance.timing_summary(timings(spark, [1, 1, 1, 9])).first()
    assert got.asDict() == want.asDict()


def test_acceptance_levels(spark):
    def judge(values, **options):
        o = SlaOptions(**options)
        return performance.batch_acceptance(performance.timing_summary(timings(spark, values), o), o).first()

    assert judge([1.0] * 20)["overall_acceptance"] == "Met"
    assert judge([1.0] * 5)["overall_acceptance"] == "Partially Evaluated"
    assert judge([1.0] * 51)["overall_acceptance"] == "Not Met"
    assert judge([6.0] * 20)["sla_acceptance"] == "Not Met"
    empty = judge([])
    assert empty["overall_acceptance"] == "Not Evaluated" and empty["processed_files"] == 0
    assert judge([2.0] * 20)["throughput_per_minute"] == 30.0
    none = performance.timing_evidence(performance.timing_acceptance(performance.timing_summary(timings(spark, [])))).first()
    assert none["sla_tested"] is False and none["message"].startswith("No timed")
    assert SlaOptions(sla_seconds=-1).sla() == 5.0


def test_pixel_statistics_equal_numpy(spark):
    image = np.random.RandomState(3).randint(0, 256, (5, 7))
    rows = [("i", x, y, int(image[y, x])) for y in range(5) for x in range(7)]
    got = quality.pixel_statistics(spark.createDataFrame(rows, "image_id string, x int, y int, gray int")).first()
    p = np.pad(image.astype(float), 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    assert got["blur_score"] == pytest.approx(lap.var()) and got["contrast"] == pytest.approx(image.std())
    assert got["brightness"] == pytest.approx(image.mean()) and (got["width"], got["height"]) == (7, 5)
    assert got["glare_ratio"] == pytest.approx((image >= 245).mean())


def test_quality_bands(spark):
    cols = "width int, height int, brightness double, contrast double, blur_score double, glare_ratio double, dark_ratio double, skew_angle double"
    rows = [(900, 900, 120.0, 40.0, 90.0, 0.0, 0.0, 0.0), (100, 100, 10.0, 1.0, 1.0, 0.9, 0.9, -20.0)]
    good, bad = quality.quality_verdict(spark.createDataFrame(rows, cols)).withColumn(
        "notes", quality.preprocessing_notes()).collect()
    assert (good["readability_score"], good["status"], good["warnings"]) == (100.0, "Pass", [])
    assert good["notes"][-1] == "No obvious image quality issues detected."
    assert (bad["status"], bad["severity"], len(bad["warnings"])) == ("Fail", "High", 8)
    assert "skew -20.0." in bad["notes"][0]


@pytest.mark.parametrize("name, masked", [
    ("Evidence", False), ("Confidence", False), ("Brand Name", False), ("country_of_origin", False),
    ("Explanation", False), ("Tooltip", False), ("Expected", True), ("Observed", True), ("Message", True),
    ("Beverage Type", True), ("Extracted Label Text", True), ("Application", True), ("Extracted", True),
    ("Performance Message", True), ("Status", False)])
def test_redaction_precedence(name, masked):
    assert redaction.is_sensitive_column(name) is masked


def test_strict_redaction_closes_the_leaks():
    assert all(redaction.is_sensitive_column(n, strict=True) for n in ("Evidence", "Brand Name", "country_of_origin"))
    assert not redaction.is_sensitive_column("Status", strict=True)


def test_redacted_values_and_audit(spark):
    df = spark.createDataFrame([("x", 1.5, "keep"), (" ", float("nan"), "keep")], "Expected string, Observed double, Status string")
    rows = redaction.redact_table(df).collect()
    assert [tuple(r) for r in rows] == [("[REDACTED]", "[REDACTED]", "keep"), ("", "", "keep")]
    audit = redaction.redaction_audit(df).first()
    assert audit["redacted_fields"] == ["Expected", "Observed"] and audit["redaction_applied"]
    assert redaction.redaction_audit(df.limit(0)).first()["message"].startswith("DataFrame was empty")
    free = RetentionOptions(no_persistence_mode=False, extracted_data_export_enabled=True)
    assert redaction.redact_table(df, free).first()["Expected"] == "x"
    assert not RetentionOptions(extracted_data_export_enabled=True).can_export_values


def test_retention(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 9),)], "created_on timestamp")
    assert redaction.retained(df, dt.datetime(2024, 1, 10), 7).count() == 1
    assert redaction.retained(df, dt.datetime(2024, 1, 10), 0).count() == 2


def test_checklists(spark):
    items = spark.createDataFrame(
        [("a", "1", "x", "Pass", ""), ("a", "2", "y", "Fail", ""), ("b", "1", "x", "Pass", ""), ("c", "1", "z", "Not Tested", "")],
        "checklist string, item_id string, name string, status string, notes string")
    got = {r["checklist"]: r["overall_status"] for r in checklists.accessibility_rollup(items, high_contrast=True, large_text=True).collect()}
    assert got == {"a": "Not Met", "b": "Met", "c": "Partially Met"}
    bare = {r["checklist"]: r["overall_status"] for r in checklists.accessibility_rollup(items).collect()}
    assert bare["b"] == "Partially Met"
    fixes = spark.createDataFrame([("2", "Pass", "ok"), ("1", "Odd", "no")], "item_id string, status string, notes string")
    done = checklists.apply_status_overrides(items, fixes).collect()
    assert {(r["item_id"], r["status"], r["notes"]) for r in done} >= {("2", "Pass", "ok"), ("1", "Pass", "")}


def test_run_verdict(spark):
    def verdict(*v):
        return spark.range(1).select(evidence.run_verdict(*[F.lit(x) for x in v])).first()[0]

    assert verdict(1, 5, 0, 0, 0) == verdict(0, 5, 0, 1, 0) == "Fail"
    assert verdict(0, 5, 1, 0, 0) == verdict(0, 5, 0, 0, 1) == "Partial"
    assert verdict(0, 5, 0, 0, 0) == "Pass" and verdict(0, 0, 0, 0, 0) == "Not Evaluated"
    with pytest.raises(ValueError):
        evidence.flags_table(spark, {"NO_SUCH_FLAG": True})


def test_diagnostics_without_text(spark):
    df = spark.createDataFrame([("f", "", "", 1.23456, ["Too dark", "glare"])], "file_name string, raw_text string, ocr_engine string, ocr_seconds double, image_quality_notes array<string>")
    rows = rp.diagnostics(df).orderBy("ordinal").collect()
    assert [r["Diagnostic"] for r in rows][3:] == ["Image Quality Note 1", "Image Quality Note 2"]
    assert rows[1]["Value"] == "Not reported" and rows[2]["Value"] == "1.235"
    assert rows[0]["Reviewer Guidance"].startswith("Request clearer artwork")


def test_summary_of_skewed_and_unnamed_batches(spark):
    rnd = np.random.RandomState(5)
    rows = [("hot" if i % 3 else None, float(v)) for i, v in enumerate(rnd.gamma(2.0, 2.0, 3000))]
    rows += [("flat", 4.25)] * 500
    df = spark.createDataFrame(rows, "batch string, processing_seconds double")
    got = {r["batch"]: r for r in performance.timing_summary(df, by=("batch",)).collect()}
    assert set(got) == {"hot", None, "flat"}
    for name, row in got.items():
        values = [v for b, v in rows if b == name]
        for column, q in (("median_seconds", 50), ("p90_seconds", 90), ("p95_seconds", 95)):
            assert row[column] == pytest.approx(np.percentile(values, q))
