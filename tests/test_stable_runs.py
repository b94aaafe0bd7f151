"""Runs without row ids, folders in names, repeated listings, and repairs of single operators."""

import json

from pyspark.sql import functions as F

from attestra.functions.fuzzy import partial_ratios
from attestra.operators.checklists import apply_status_overrides
from attestra.plans import batch
from attestra.sinks.writers import json_lines
from checks.fixture import labels

SF = "/root/testdata/sf0.001"


def test_documented_use_without_row_ids(spark):
    rows = labels(spark, SF).where("row_id < 40")
    manifest = rows.select("row_id", "file_name", *batch.APPLICATION)
    manifest = manifest.unionByName(manifest.where("row_id = 7"))
    texts = rows.where("row_id <> 5").select(F.concat(F.lit("/in/"), "file_name").alias("file_name"), "raw_text")
    run = batch.run_manifest_batch(manifest, texts.unionByName(texts.where("file_name like '%7.png'")))
    names = {r["file_name"]: r["processed"] for r in run.reports.collect()}
    assert len(names) == rows.count() and [n for n, done in names.items() if not done] == ["label_000000005.png"]
    listed = {r["File Name"]: r["count"] for r in run.summary.groupBy("File Name").count().collect()}
    assert listed["label_000000007.png"] == 2 and sum(listed.values()) == manifest.count()
    assert run.performance.count() == manifest.count() - 1
    assert run.validation.first()["missing_files"] == 1


def test_overrides_for_one_item_change_it_once(spark):
    items = spark.createDataFrame([("a", "i1", "c", "n", "Untested", "")],
                                  "checklist string, item_id string, category string, name string, status string, notes string")
    changes = spark.createDataFrame([("i1", "Passed", "late", 2), ("i1", "Failed", "early", 1)],
                                    "item_id string, status string, notes string, position int")
    known = {r["status"] for r in apply_status_overrides(items, changes).collect()}
    assert apply_status_overrides(items, changes).count() == 1
    assert len(known) == 1


def test_map_keys_are_redacted(spark):
    df = spark.sql("""select map('raw_text', 'secret words', 'status', 'Pass') as a,
                      map('raw_text', array('secret words')) as b, array(map('raw_text', 5)) as c,
                      named_struct('m', map('brand_name', 'x', 'raw_text', 'secret words')) as d""")
    line = json_lines(df).first()["value"]
    assert "secret" not in line and "5" not in line
    assert json.loads(line)["a"]["status"] == "Pass"


def test_needles_with_very_many_letters():
    needle = "".join(chr(0x4E00 + k) for k in range(6000))
    assert partial_ratios([(needle, "abc" * 3000)]) == [0.0]
    text = "x" + needle[:5000] + "y" * 2000
    shifted = needle[:5000] + needle[:1000]
    assert partial_ratios([(needle, text)])[0] > 80
    assert partial_ratios([(shifted, shifted + "z")]) == [100.0]


def test_pipeline_hands_long_texts_on_in_small_batches(spark, monkeypatch):
    import corpus_pipeline

    batch, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(batch)

    def stage(session, docs, sf_dir):
        seen.append(int(session.conf.get(batch)))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", stage), ("last", stage)])
    try:
        for given, used in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("200", 200)):
            spark.conf.set(batch, given)
            assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
            assert seen[-2:] == [used, used]
    finally:
        spark.conf.set(batch, before)
