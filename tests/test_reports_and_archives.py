"""Archive members in chunks, report lines, and the package of outputs."""

from __future__ import annotations

import io
import json
import zipfile

import pytest

from attestra.constants import FAIL, MET, NOT_MET, PASS
from attestra.operators import performance
from attestra.plans.acceptance import run_acceptance
from attestra.schema import RetentionOptions
from attestra.sinks import markdown
from attestra.sinks.writers import write_markdown, write_outputs
from attestra.sources import artwork


def zipped(members, kind=zipfile.ZIP_DEFLATED):
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", kind) as archive:
        for name, data in members:
            archive.writestr(name, data)
    return whole.getvalue()


@pytest.fixture(scope="module")
def chunked(spark):
    data = {"a.png": b"", "b/c.PNG": b"x" * 1000, "d.pdf": bytes(range(256)) * 500, "e.jpg": b"y" * 1001}
    refused = [("../x.png", b"1"), ("__MACOSX/y.png", b"1"), (".z.png", b"1"), ("/q.png", b"1"), ("note.txt", b"1"), ("dir/", b"")]
    good = zipped([*data.items(), *refused])
    stored = zipped(data.items(), zipfile.ZIP_STORED)
    broken = bytearray(stored)
    broken[broken.index(b"y" * 1001) + 5] = ord("z")
    cut = zipped([("long.png", bytes(i * i % 251 for i in range(50_000)))])
    spoiled = bytearray(cut)
    spoiled[200:260] = b"\xff" * 60
    rows = [("/u/good.zip", good), ("/u/stored.zip", stored), ("/u/broken.zip", bytes(broken)), ("/u/spoiled.zip", bytes(spoiled)),
            ("/u/no.zip", b"not an archive"), ("/u/null.zip", None), ("/v/good.zip", good),
            ("/u/other.zip", zipped([("m.png", b"abc")], zipfile.ZIP_LZMA))]
    archives = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    found = artwork.member_chunks(artwork.list_members(archives), 1000).collect()
    return data, found


def test_members_come_in_numbered_chunks(chunked):
    data, found = chunked
    for path in ("/u/good.zip", "/u/stored.zip", "/v/good.zip"):
        mine = [r for r in found if r["path"] == path]
        assert {r["member"] for r in mine} == set(data) and all(r["source"] == path[3:] for r in mine)
        for member, whole in data.items():
            parts = sorted((r["chunk"], bytes(r["content"])) for r in mine if r["member"] == member)
            assert [k for k, _ in parts] == list(range(max(1, -(-len(whole) // 1000))))
            assert b"".join(p for _, p in parts) == whole and all(len(p) <= 1000 for _, p in parts)


def test_faults_stay_with_their_member(chunked):
    data, found = chunked
    broken = [r for r in found if r["path"] == "/u/broken.zip"]
    assert {r["member"] for r in broken if r["error"]} == {"e.jpg"}
    assert {r["member"] for r in broken if not r["error"]} >= {"a.png", "b/c.PNG", "d.pdf"}
    for path, text in (("/u/spoiled.zip", "could not be read"), ("/u/no.zip", "Archive could not be read"),
                       ("/u/null.zip", "Archive could not be read"), ("/u/other.zip", "compression method")):
        assert any(text in (r["error"] or "") for r in found if r["path"] == path)


def test_report_lines_are_those_of_the_values(spark, tmp_path):
    timings = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0)], "batch_id string, processing_seconds double")
    lines = markdown.timing_markdown(performance.timing_acceptance(
        performance.timing_summary(timings, by=("batch_id",))), ("batch_id",)).collect()
    text = {b: "\n".join(r["line"] for r in sorted(lines, key=lambda r: r["ordinal"]) if r["batch_id"] == b) for b in "ab"}
    assert text["a"].startswith("# Performance Summary\n\nTotal Files: 2\nAverage Seconds: 2.000\n")
    assert "Status: Met\nMeets Acceptance: True" in text["a"] and "Meets Acceptance: False" in text["b"]

    items = spark.createDataFrame(
        [("one", "A-1", "first", PASS, "ok"), ("one", "A-2", "second", FAIL, None), ("two", "A-1", "only", PASS, "")],
        "checklist string, item_id string, name string, status string, notes string")
    report = markdown.accessibility_markdown(items, "now", high_contrast=True, large_text=True)
    assert write_markdown(report.where("checklist = 'one'").drop("checklist"), f"{tmp_path}/md")
    written = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/md").collect())
    assert "Accessibility Status: Not Met" in written and "### A-2 - second\n\n- Category: \n- Status: Fail" in written
    assert written.index("### A-1") < written.index("### A-2")
    checks = items.withColumnRenamed("notes", "evidence").replace({PASS: MET, FAIL: NOT_MET}, subset=["status"])
    lines = [r["line"] for r in markdown.deployment_markdown(checks, "now").collect()]
    assert lines.count("# Deployment Evidence") == 2 and "- Evidence: ok" in lines and "- Not Met: 1" in lines
    assert markdown.deployment_markdown(checks.where("false"), "now").count() == 0


def test_package_holds_every_output_and_obeys_the_policy(spark, tmp_path):
    items = spark.createDataFrame([("one", "A-1", "first", PASS)], "checklist string, item_id string, name string, status string")
    report = {"checks": markdown.accessibility_markdown(items, "now")}
    index = write_outputs({"checks": items, "empty": items.where("false")}, report, str(tmp_path / "p"), as_json=("checks",))
    rows = {(r["output"], r["format"]): r["written"] for r in index.collect()}
    assert rows == {("checks", "csv"): True, ("checks", "json"): True, ("checks", "markdown"): True, ("empty", "csv"): False}
    listed = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "p" / "package_manifest_json")).collect()]
    assert {(r["output"], r["format"]) for r in listed} == set(rows)
    closed = write_outputs({"checks": items}, report, str(tmp_path / "q"), RetentionOptions(redacted_evidence_export_enabled=False))
    assert not any(r["written"] for r in closed.collect()) and not (tmp_path / "q").exists()


def test_acceptance_run_writes_fifteen_outputs(spark, tmp_path):
    manifest = spark.createDataFrame(
        [(0, "a.png", "Old Oak", "Bourbon Whiskey", "Distilled Spirits", 40.0, 80.0, "750 mL", "Oak", False, "", "", "", "")],
        "row_id long, file_name string, brand_name string, class_type string, beverage_type string, alcohol_content double, "
        "proof double, net_contents string, producer_bottler string, imported boolean, importer string, "
        "country_of_origin string, cola_id string, notes string")
    texts = spark.createDataFrame([("a.png", "OLD OAK\nBourbon Whiskey\n40% ALC/VOL", 1.5)],
                                  "file_name string, raw_text string, ocr_seconds double")
    items = spark.createDataFrame([("run", "A-1", "first", PASS)], "checklist string, item_id string, name string, status string")
    run_acceptance(manifest, texts, str(tmp_path), accessibility=items, deployment=items.replace({PASS: MET}), created_on="now")
    outputs = sorted(p.name for p in (tmp_path / "package").iterdir())
    assert outputs == sorted([
        *[f"{n}_redacted_csv" for n in ("summary", "details", "comparison", "performance", "batch_acceptance", "acceptance",
                                        "accessibility", "deployment")],
        *[f"{n}_redacted_{k}" for n in ("acceptance", "accessibility", "deployment") for k in ("json", "md")],
        "package_manifest_json"])
    report = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "package" / "acceptance_redacted_md")).collect())
    assert report.startswith("# Acceptance Summary") and report.count("### ") == 15
