import pytest
from pyspark.sql import functions as F

from attestra.operators import matching
from attestra.plans import batch
from attestra.schema import Application
from attestra.sources import manifest as mf

HEADER = "Label File,Brand,Class/Type,Beverage,ABV,Net-Contents,Producer/Bottler,Imported,cola-id,Lot No\n"


def write(path, text, encoding):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_encodings_and_typing(spark, tmp_path):
    row = 'a.png,"Caf\u00e9 ""X""\nline",Rum,,"1,045.5%",750 mL,P\u2019s,yes,001,L1\n'
    paths = [write(tmp_path / "a.csv", HEADER + row, "utf-8-sig"), write(tmp_path / "b.csv", HEADER + row, "cp1252")]
    raw = bytes((HEADER + row.replace("\u2019", "\u00b4")).encode("cp1252")).replace(b"L1", b"L\x81")
    (tmp_path / "c.csv").write_bytes(raw)
    found = {r["path"].rsplit("/", 1)[-1]: r["encoding"]
             for r in mf.probe_encodings(spark, paths + [str(tmp_path / "c.csv")]).collect()}
    assert found == {"a.csv": "UTF-8", "b.csv": "windows-1252", "c.csv": "ISO-8859-1"}
    rows = mf.load_manifest(spark, paths + [str(tmp_path / "c.csv")]).collect()
    assert len(rows) == 3
    for r in rows:
        assert r["brand_name"] == 'Caf\u00e9 "X"\nline' and r["alcohol_content"] == 1045.5
        assert r["beverage_type"] == "Distilled Spirits" and r["imported"] is True
        assert r["producer_bottler"] in ("P\u2019s", "P\u00b4s")
        assert r["cola_id"] == "001" and r["notes"] == "" and r["proof"] is None


@pytest.mark.parametrize("header, want", [
    ("\ufeffLabel File", "file_name"), ("ABV", "alcohol_content"), ("Alcohol Content (% ABV)", "alcohol_content"),
    ("cola-id", "cola_id"), ("Lot No", "lot_no"), (" class_type ", "class_type")])
def test_header_names(header, want):
    assert mf.canonical_name(header) == want


def test_missing_columns_and_clashes(spark, tmp_path):
    path = write(tmp_path / "m.csv", "file,brand\na,b\n", "utf-8")
    with pytest.raises(ValueError, match="Missing required manifest column: class_type"):
        mf.load_manifest(spark, path)
    with pytest.raises(ValueError, match="same column"):
        mf.canonical_columns(spark.createDataFrame([("a", "b")], "brand string, `Brand Name` string"))
    empty = spark.createDataFrame([], "file_name string")
    assert mf.manifest_errors(empty) == ["Manifest is empty or could not be read."]


def frames(spark, names, uploads):
    m = spark.createDataFrame([(i, n, f"brand {i}") for i, n in enumerate(names)], "row_id long, file_name string, brand_name string")
    extra = {c: F.lit("") for c in batch.APPLICATION if c != "brand_name"}
    extra.update(alcohol_content=F.lit(None).cast("double"), proof=F.lit(None).cast("double"), imported=F.lit(False))
    u = spark.createDataFrame([(i, n, f"text {i}") for i, n in enumerate(uploads)], "row_id long, file_name string, raw_text string")
    return m.withColumns(extra), u


def names_of(df):
    return sorted(r["file_name"] for r in df.collect() for _ in range(r["occurrences"]))


def test_name_lists(spark):
    m, u = frames(spark, ["a.png", "A.PNG", "b.png", "c.png", "c.png", ""], ["a.png", "B.png", "x.png", "a.PNG"])
    assert names_of(matching.matched_names(m, u)) == ["A.PNG", "a.png", "b.png"]
    assert names_of(matching.missing_names(m, u)) == ["c.png", "c.png"]
    assert names_of(matching.extra_names(m, u)) == ["x.png"]
    assert sorted(r[0] for r in matching.duplicate_names(m).collect()) == ["A.PNG", "c.png"]
    record = matching.validation_record(m, u).first()
    assert (record["matched_files"], record["missing_files"], record["extra_files"]) == (3, 2, 1)
    assert record["duplicate_manifest_files"] == 2 and record["is_valid"] is False
    assert len(record["errors"]) == 2 and len(record["warnings"]) == 1
    exact = {r["file_name"]: r["state"] for r in matching.exact_name_match(m, u).collect()}
    assert exact["a.png"] == "matched" and exact["A.PNG"] == "missing" and exact["a.PNG"] == "extra"


def test_first_name_duplicated_later_in_the_same_case(spark):
    m, _ = frames(spark, ["a", "A", "a"], [])
    assert sorted(r[0] for r in matching.duplicate_names(m).collect()) == ["A", "a"]
    record = matching.validation_record(m, frames(spark, [], ["a"])[1]).first()
    assert record["duplicate_manifest_files"] == 2


def test_empty_sides(spark):
    m, u = frames(spark, ["a"], ["a"])
    for left, right in ((m.limit(0), u), (m, u.limit(0))):
        record = matching.validation_record(left, right).first()
        assert record["is_valid"] is False and record["matched_files"] == 0 and len(record["errors"]) == 1


def test_last_wins_and_every_listing_is_kept(spark):
    m, u = frames(spark, ["a.png", "A.png", "a.png", "gone.png"], ["a.png", "A.PNG"])
    made = batch.verify_batch(m, u)
    rows = {r["file_name"]: r for r in made.collect()}
    assert set(rows) == {"A.PNG", "gone.png"}
    assert rows["A.PNG"]["brand_name"] == "brand 2" and rows["A.PNG"]["raw_text"] == "text 1"
    assert rows["A.PNG"]["occurrences"] == 3 and rows["gone.png"]["results"][0]["rule_id"] == "batch_processing_error"
    expanded = batch.expand_occurrences(made.select("file_name", "occurrences"))
    assert sorted(r[0] for r in expanded.collect()) == ["A.PNG"] * 3 + ["gone.png"]


def test_hot_name_expands_whole(spark):
    n = 2 * batch.COPIES_PER_TASK + 7
    df = spark.createDataFrame([("hot", n), ("cold", 1)], "file_name string, occurrences long")
    made = batch.expand_occurrences(df).groupBy("file_name").count().collect()
    assert {r[0]: r[1] for r in made} == {"hot": n, "cold": 1}


def test_readiness(spark):
    m, u = frames(spark, ["a.png"], ["b.png"])
    assert "No uploaded label artwork" in matching.readiness(m, u).first()["message"]
    assert matching.readiness(m, u.limit(0)).first()["message"].startswith("Upload matching")
    assert matching.readiness(m.limit(0), u).first()["message"].startswith("The manifest is uploaded")
    full = Application("b", "c", "Wine", 12.0, None, "750 mL", "p", government_warning="w")
    assert matching.readiness(None, u, full).first()["mode"] == "Manual CAV + Artwork Review"
    assert matching.readiness(None, u).first()["message"].startswith("Complete the required")
    assert matching.readiness(None, u.limit(0)).first()["message"].startswith("Upload label artwork")
