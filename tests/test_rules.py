import pytest
from pyspark.sql import functions as F

from attestra.constants import WARNING_TEXT
from attestra.operators import reports as rp
from attestra.operators import rules, warning
from attestra.plans import batch
from attestra.schema import Application, RuleOptions

APP = Application(brand_name="OLD TOM", class_type="Bourbon Whiskey", alcohol_content=45.0,
                  net_contents="750 mL", producer_bottler="Old Tom", imported=True,
                  country_of_origin="Ireland")
CLEAN = ("OLD TOM\nBourbon Whiskey\n45% ALC/VOL / 90 PROOF\nNET CONTENTS: 750 mL\nBOTTLED BY Old Tom\n"
         "IMPORTED BY X\nPRODUCT OF Ireland\n" + WARNING_TEXT)


def verify(spark, text, app=APP, **options):
    table = batch.verify_text(spark, app, text, options=RuleOptions(**options))
    rows = rp.detail_rows(table).orderBy("ordinal").collect()
    return {r["rule_id"]: r for r in rows}, table


def test_clean_import_passes_all_but_the_visual_check(spark):
    got, table = verify(spark, CLEAN)
    assert len(got) == 15 and list(got)[-2:] == ["importer_present", "country_of_origin_present"]
    assert {k for k, r in got.items() if r["status"] != "Pass"} == {"government_warning_visual_format"}
    assert table.select(rp.overall_status(F.col("results"))).first()[0] == "Needs Review"
    assert got["government_warning_exact"]["confidence"] == 100.0
    # The country group runs over the line end.
    assert got["country_of_origin_present"]["observed"] == "PRODUCT OF Ireland\nGOVERNMENT WARNING"


def test_wording_that_only_the_extractor_reads(spark):
    got, table = verify(spark, CLEAN.replace("45% ALC/VOL", "ALC. 45% BY VOL").replace(
        "PRODUCT OF Ireland", "COUNTRY OF ORIGIN: Ireland"))
    assert got["alcohol_content_present"]["status"] == got["alcohol_content_match"]["status"] == "Fail"
    assert got["proof_consistency"]["status"] == "Warning"
    assert got["country_of_origin_present"]["status"] == "Fail"
    fields = table.select("extracted.*").first()
    assert fields["alcohol_content"] == 45.0 and fields["country_of_origin"] == "Ireland"


def test_zero_abv_quirks(spark):
    got, _ = verify(spark, "0% ALC/VOL 90 PROOF", Application(brand_name="x", alcohol_content=0.0))
    assert got["alcohol_content_present"]["status"] == "Pass"
    assert got["alcohol_content_match"]["observed"] == "No expected ABV provided"
    assert got["proof_consistency"]["observed"] == "Rule execution failed"
    assert got["proof_consistency"]["requires_human_review"] is True
    seen, _ = verify(spark, "0% ALC/VOL", Application(alcohol_content=45.0))
    assert seen["alcohol_content_match"]["status"] == "Fail"
    assert seen["alcohol_content_match"]["observed"] == "0% ABV"


def test_fuzzy_brand_and_thresholds(spark):
    app = Application(brand_name="RED WIDGET'S DISTILLING")
    text = "RED WIDGETS DISTILLING\nECONOMY Bourbon"
    got, _ = verify(spark, text, app)
    assert got["brand_name_match"]["status"] == "Pass"
    assert got["brand_name_match"]["confidence"] == pytest.approx(97.7778, abs=1e-4)
    strict, _ = verify(spark, text, app, brand_threshold=99.0)
    assert strict["brand_name_match"]["status"] == "Needs Review"
    none, _ = verify(spark, "some text", Application())
    assert none["brand_name_match"]["observed"] == "No expected brand name provided"


def test_altered_and_lower_case_warning(spark):
    got, _ = verify(spark, WARNING_TEXT.replace("Surgeon", "Surgical"))
    exact = got["government_warning_exact"]
    assert exact["status"] == "Fail" and exact["confidence"] == pytest.approx(98.54, abs=.005)
    assert exact["observed"].startswith("Near match")
    lower, _ = verify(spark, WARNING_TEXT.replace("GOVERNMENT WARNING", "Government Warning"))
    assert lower["government_warning_exact"]["status"] == "Pass"
    assert lower["government_warning_prefix_caps"]["status"] == "Fail"


def test_other_beverages_and_unreadable_text(spark):
    got, _ = verify(spark, "12% ABV", Application(beverage_type="Wine"))
    assert got["proof_present"]["status"] == got["proof_consistency"]["status"] == "Not Applicable"
    rows, table = verify(spark, " \n\t")
    assert list(rows) == ["ocr_text_extraction"]
    assert rows["ocr_text_extraction"]["evidence"].startswith("Manual text")
    assert table.select(rp.overall_status(F.col("results"))).first()[0] == "Needs Review"
    # Direct text that is missing is an input error, not an unreadable label.
    rows, table = verify(spark, "")
    assert list(rows) == ["verification_unavailable"]
    assert table.select(rp.overall_status(F.col("results"))).first()[0] == "Needs Review"


def test_failure_counts_as_review_too(spark):
    _, table = verify(spark, "nothing here", Application(brand_name="x"))
    row = rp.summary(table).first()
    assert row["Failures"] > 0 and row["Needs Review"] > row["Failures"]
    assert row["Overall Status"] == "Fail"
    empty = table.withColumn("results", F.array().cast(table.schema["results"].dataType))
    row = rp.summary(empty).first()
    assert (row["Overall Status"], row["Needs Review"], row["Failures"]) == ("Needs Review", 1, 0)


def test_warning_alone(spark):
    df = spark.createDataFrame([(WARNING_TEXT, ["blurry"]), ("", [])], "raw_text string, notes array<string>")
    full, blank = warning.validate_warnings(df, notes="notes").collect()
    assert full["warning"]["risk_level"] == "High" and full["warning"]["exact_text_match"]
    assert [r["rule_id"] for r in full["warning_results"]] == list(warning.WARNING_RULES)
    assert blank["warning_results"][0]["rule_id"] == "government_warning_validation_unavailable"


def test_rules_run_each_python_step_once_and_without_shuffle(spark):
    df = spark.createDataFrame([("f", CLEAN, [])], "file_name string, raw_text string, image_quality_notes array<string>")
    labels = df.withColumns({k: F.lit(v) for k, v in vars(APP).items()})
    plan = rp.detail_rows(rules.verify_labels(labels))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "Exchange" not in plan  # folding, scores


def test_rows_that_cannot_be_verified_get_one_result(spark):
    from attestra.operators import rules
    from attestra.plans.batch import verify_text
    from attestra.schema import Application

    rows = [(k, name, text, given) for k, (name, text, given) in enumerate([
        ("a.png", "OLD OAK", True), ("a.png", "OLD OAK", False), ("a.png", None, True), ("", "OLD OAK", True), ("a.png", " \n", True),
        (None, None, None)])]
    labels = spark.createDataFrame(rows, "k int, file_name string, raw_text string, given boolean").selectExpr(
        "*", "'Old Oak' as brand_name", "'Vodka' as class_type", "'Distilled Spirits' as beverage_type", "40.0d as alcohol_content",
        "80.0d as proof", "'750 mL' as net_contents", "'Oak' as producer_bottler", "false as imported", "'' as importer",
        "'' as country_of_origin", "array() as image_quality_notes")
    every = "brand_name_match"
    want = {
        "file": [every, "verification_exception", "ocr_text_extraction", every, "ocr_text_extraction", "verification_exception"],
        "text": [every, "verification_unavailable", "verification_unavailable", "verification_unavailable", "ocr_text_extraction",
                 "verification_unavailable"],
        "rules": [every, "verification_rules_unavailable", "verification_rules_unavailable", every, every,
                  "verification_rules_unavailable"]}
    for entry, ids in want.items():
        done = sorted(rules.verify_labels(labels, entry=entry, given=F.col("given")).collect(), key=lambda r: r["k"])
        assert [r["results"][0]["rule_id"] for r in done] == ids
        for r, rule in zip(done, ids):
            assert len(r["results"]) == (13 if rule == every else 1)
            assert rule == every or (r["results"][0]["status"], r["results"][0]["confidence"]) == ("Needs Review", 0.0)
            assert all(x["confidence"] is not None for x in r["results"])
        if entry == "file":
            assert done[1]["results"][0]["evidence"] == 'ValueError: Argument "application" cannot be empty!'
    report = verify_text(spark, Application(brand_name="Old Oak"), "").first()
    assert [r["rule_id"] for r in report["results"]] == ["verification_unavailable"]
