"""Narrow rows are dealt over tasks by their number, not by the bytes of their file."""

from pyspark.sql import functions as F

from attestra.functions import text as tx
from attestra.operators import needles, rules
from attestra.sources import artwork
from attestra.sources.spread import spread
from checks import QUERIES
from checks.fixture import labels


def test_rows_of_one_file_are_dealt_by_number(spark, tmp_path):
    spark.range(10_001).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = spark.read.parquet(str(tmp_path / "one"))
    assert rows.rdd.getNumPartitions() == 1
    dealt = spread(rows, "id", rows_per_task=1_000)
    assert dealt.rdd.getNumPartitions() == 11
    assert sorted(r["id"] for r in dealt.collect()) == list(range(10_001))
    largest = dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 2_000
    assert spread(rows.limit(5), "id").count() == 5 and spread(rows.where("false"), "id").count() == 0


def test_labels_of_one_part_file_make_several_tasks(spark):
    made = labels(spark, "/root/testdata/sf0.1")
    assert made.rdd.getNumPartitions() == 10
    assert made.select("row_id").distinct().count() == 20_000


def test_context_makes_each_form_once(spark):
    rows = spark.createDataFrame([("a  The\tRed  Fox b", "red fox")], "t string, p string")
    found = rows.select(tx.extract_context(F.col("t"), F.col("p"), 4).alias("c"))
    assert found.first()["c"] == "the red fox b"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_replace") == 2  # one per value


def test_strip_looks_at_the_ends_only(spark):
    rows = spark.createDataFrame([("  \x1c　a  b\u0085\n",), ("  ",), (None,)], "v string")
    stripped = rows.select(tx.strip(F.col("v")).alias("s"))
    assert [r["s"] for r in stripped.collect()] == ["a  b", "", ""]
    assert "regexp" not in stripped._jdf.queryExecution().optimizedPlan().toString().lower()


def test_small_members_leave_in_one_frame():
    rows = [("a.zip", "a.zip", f"m{k}", 3, 0, b"abc", None) for k in range(2_500)]
    frames = list(artwork._frames(iter(rows), artwork._CHUNKS))
    assert [len(f) for f in frames] == [1_000, 1_000, 500]
    large = [(*r[:5], b"x" * (3 << 20), None) for r in rows[:5]]
    assert [len(f) for f in artwork._frames(iter(large), artwork._CHUNKS)] == [2, 2, 1]


def test_keys_of_texts_travel_as_bytes(spark):
    rows = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, None)], "id int, t string")
    keys = {r["id"]: r["key"] for r in needles._forms(rows, "id", "t", "key").collect()}
    assert set(keys) == {1, 2} and keys[1] == keys[2] and isinstance(keys[1], (bytes, bytearray)) and len(keys[1]) == 16


def test_entries_run_the_rules_once(spark):
    rows = labels(spark, "/root/testdata/sf0.001").withColumn(
        "raw_text", F.when(F.col("row_id") % 6 != 2, F.col("raw_text")))
    given = F.col("row_id") % 3 != 0
    every = rules.verify_entries(rows, given=given).select("row_id", "entry", "results")
    for entry in (rules.FROM_FILE, rules.FROM_TEXT, rules.FROM_RULES):
        one = rules.verify_labels(rows, entry=entry, given=given).select("row_id", F.lit(entry).alias("entry"), "results")
        mine = every.where(F.col("entry") == entry)
        assert one.exceptAll(mine).count() == 0 and mine.count() == one.count()
    plan = QUERIES["fallback_results"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == one._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
