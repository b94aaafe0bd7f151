"""The order of rows in their source files decides which of several is the last."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import matching
from attestra.sources.label_text import label_text
from attestra.sources.manifest import load_manifest

HEAD = "File Name,Brand Name,Class Type,Beverage Type,Alcohol Content,Net Contents,Producer Bottler"


def test_last_manifest_row_wins_across_encodings(spark, tmp_path):
    # The first path holds code page 1252, the second UTF-8, the third Latin-1 with undefined bytes.
    files = {"a.csv": ("cp1252", ["x.png,Old – brand", "y.png,Only"]), "b.csv": ("utf-8", ["x.png,Größe", "z.png,First"]),
             "c.csv": ("latin-1", ["z.png,Last\x81é"])}
    for name, (encoding, rows) in files.items():
        text = "\n".join([HEAD, *(f"{r},c,wine,1,2,p" for r in rows)]) + "\n"
        (tmp_path / name).write_bytes(text.encode(encoding))
    manifest = load_manifest(spark, [str(tmp_path / n) for n in ("b.csv", "c.csv", "a.csv")])
    rows = sorted((r["row_id"], r["file_name"], r["brand_name"]) for r in manifest.collect())
    assert rows == [(0, "x.png", "Old – brand"), (1, "y.png", "Only"), (2, "x.png", "Größe"), (3, "z.png", "First"),
                    (4, "z.png", "Last\x81é")]
    last = {r["file_name"]: r["brand_name"] for r in matching.last_records(manifest).collect()}
    assert last == {"x.png": "Größe", "y.png": "Only", "z.png": "Last\x81é"}


def test_rows_of_split_files_are_numbered_in_order(spark, tmp_path):
    for k in range(3):
        lines = [HEAD] + [f"{k}-{i:05}.png,b,c,wine,1,2,p" for i in range(4000)]
        (tmp_path / f"{k}.csv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        manifest = load_manifest(spark, str(tmp_path), multi_line=False)
        assert manifest.rdd.getNumPartitions() > 3
        rows = sorted((r["row_id"], r["file_name"]) for r in manifest.select("row_id", "file_name").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [n for _, n in rows] == [f"{k}-{i:05}.png" for k in range(3) for i in range(4000)]
    assert [i for i, _ in rows] == list(range(12_000))


def test_the_last_upload_of_a_file_wins_without_row_ids(spark, tmp_path):
    rows = [("a.png", "zzz first"), ("b.png", "only"), ("A.png", "aaa last")]
    for kind in ("parquet", "json", "csv"):
        path = f"{tmp_path}/{kind}"
        spark.createDataFrame(rows, "file_name string, raw_text string").coalesce(1).write.format(kind).option(
            "header", True).save(path)
        read = spark.read.option("header", True).format(kind).load(path)
        texts = label_text(read)
        last = matching.last_uploads(texts).where("key = 'a.png'").select("upload_row", "upload_name").first()
        assert last["upload_name"] == "A.png"
        kept = texts.where(F.col("row_id") == F.lit(last["upload_row"])) if kind == "never" else texts.join(
            matching.last_uploads(texts).select(F.col("upload_row").alias("row_id")), "row_id")
        assert {r["raw_text"] for r in kept.collect()} == {"aaa last", "only"}
        assert [r["times"] for r in matching.duplicate_upload_warnings(texts).collect()] == [1]


def test_identical_uploads_warn_once(spark):
    for rows in ([("a.png", "same")] * 2, [("a.png", "same")] * 3 + [("A.png", "other")]):
        texts = label_text(spark.createDataFrame(rows, "file_name string, raw_text string"))
        warned = matching.duplicate_upload_warnings(texts).collect()
        assert [r["times"] for r in warned] == [len(rows) - 1]
