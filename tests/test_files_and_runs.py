import datetime as dt
import json
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from attestra.operators.redaction import retained
from attestra.plans import acceptance, batch
from attestra.schema import RetentionOptions
from attestra.sinks import markdown, writers
from attestra.sources import artwork
from attestra.streaming import labels as stream
from checks.fixture import labels

SF = "/root/testdata/sf0.001"


def content(path):
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


def test_artwork_listing_and_archives(spark, tmp_path):
    for name in ("b.PNG", "A.pdf", "notes.txt", "c.tiff"):
        (tmp_path / name).write_bytes(b"x" * 2048)
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        for member in ("ok/d.png", "../evil.png", "__MACOSX/e.png", "ok/.hidden.png", "/abs.png", "ok/readme.md", "f.JPG"):
            z.writestr(member, b"y" * 512)
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    files = artwork.list_artwork(spark, str(tmp_path))
    assert [r["file_name"] for r in files.collect()] == ["A.pdf", "b.PNG", "c.tiff"]
    assert artwork.list_artwork(spark, str(tmp_path), limit=2).count() == 2
    assert artwork.list_artwork(spark, str(tmp_path), limit=-3).count() == 0
    zips = spark.read.format("binaryFile").load(str(tmp_path / "*.zip"))
    members = artwork.expand_archives(zips)
    read = members.where("error is null").collect()
    assert {(r["file_name"], bytes(r["content"])) for r in read} == {("d.png", b"y" * 512), ("f.JPG", b"y" * 512)}
    failed = members.where("error is not null").collect()
    assert [(r["source"], r["member"]) for r in failed] == [("broken.zip", None)]
    raw = bytearray((tmp_path / "in.zip").read_bytes())
    at = raw.index(b"ok/d.png") + len("ok/d.png")
    raw[at] ^= 0xFF  # one member no longer matches its checksum
    bent = spark.createDataFrame([("/z/bent.zip", bytes(raw))], "path string, content binary")
    rows = {r["file_name"]: r["error"] for r in artwork.expand_archives(bent).collect()}
    assert rows["f.JPG"] is None and rows["d.png"].startswith("Member could not be read")
    table = {r["File Name"]: r for r in artwork.inventory(files, members).collect()}
    assert table["d.png"]["Source"] == "in.zip" and table["d.png"]["Size KB"] == 0.5
    assert table["b.PNG"]["Type"] == "png" and table["b.PNG"]["Input Type"] == "Uploaded File"


def sides(spark):
    rows = labels(spark, SF)
    manifest = rows.select("row_id", "file_name", *batch.APPLICATION)
    texts = rows.select("row_id", "file_name", "raw_text", "ocr_seconds", "image_quality_notes")
    return manifest, texts.where("row_id <> 5")


def test_acceptance_run_writes_a_redacted_package(spark, tmp_path):
    run = acceptance.run_acceptance(*sides(spark), str(tmp_path))
    got = {r["requirement_id"]: r["status"] for r in run.requirements.collect()}
    assert len(got) == 15 and got["1.1"] == got["1.2"] == got["1.3"] == "Met"
    assert got["2.2"] == "Partially Met"  # one manifest row has no upload
    assert run.verdict.first()["status"] == "Fail"
    details = content(tmp_path / "package" / "details_redacted_csv")
    assert "[REDACTED]" in details and "According to the Surgeon" not in details.split("\n")[1]
    assert run.batch.reports.where("not processed").count() == 1


def test_sinks_obey_the_policy(spark, tmp_path):
    df = spark.createDataFrame([("a", "s")], "Expected string, Status string")
    off = RetentionOptions(redacted_evidence_export_enabled=False)
    assert not writers.write_redacted_csv(df, str(tmp_path / "x"), off)
    assert not writers.write_redacted_csv(df.limit(0), str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()
    nested = df.select(F.struct(F.lit("t").alias("raw_text"), F.lit("s").alias("status")).alias("report"))
    assert writers.write_redacted_json(nested, str(tmp_path / "j"))
    assert json.loads(content(tmp_path / "j")) == {"report": {"raw_text": "[REDACTED]", "status": "s"}}


def test_markdown(spark, tmp_path):
    manifest, texts = sides(spark)
    reports = batch.verify_batch(manifest, texts, created_on=F.lit("2026-01-01").cast("timestamp"))
    text = markdown.label_markdown(reports.limit(1)).first()["markdown"]
    assert text.startswith("# Label Verification Report") and "| brand_name_match |" in text or "ocr_text_extraction" in text
    assert "**File:** [REDACTED]" in text
    closed = markdown.label_markdown(reports, RetentionOptions(strict=True))
    assert closed.where(F.contains("markdown", F.lit("Surgeon General"))).count() == 0
    assert writers.write_markdown(markdown.batch_markdown(reports, "2026-01-01"), str(tmp_path / "m"))
    body = content(tmp_path / "m")
    assert body.startswith("# Batch Verification Report") and "## Rule Details" in body
    assert body.index("## Batch Summary") < body.index("## Rule Details") < body.index("## Data Retention Notice")


def test_error_log_append_and_purge(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d), "c" * 200, "m", "x", "pw secret=abc", "i", "t") for d in (1, 9)]
    errors = spark.createDataFrame(rows, "created_on timestamp, cause string, module string, method string, message string, info string, trace string")
    writers.append_error_log(errors, str(tmp_path / "log"))
    writers.append_error_log(errors, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and retained(log, dt.datetime(2024, 1, 10)).count() == 2
    row = log.first()
    assert len(row["cause"]) == 120 and row["message"] == "pw secret=[SECRET]"


def test_stream_equals_batch(spark, tmp_path):
    manifest, texts = sides(spark)
    texts.drop("row_id").write.parquet(str(tmp_path / "in"))
    schema = texts.drop("row_id").schema
    arriving = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = stream.start_verification(arriving, manifest, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("file_name", F.size("results").alias("n"))
    want = batch.verify_batch(manifest, texts, with_missing=False).select("file_name", F.size("results").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
