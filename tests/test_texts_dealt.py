"""Long texts of a file with one row group are dealt over tasks; those in many parts stay."""

import pytest
from pyspark.sql import functions as F

from attestra.sources.spread import spread_texts
from checks import QUERIES
from checks.registry import documents

SF = "/root/testdata/sf0.1"  # 10,000 documents in one row group


def held(rows):
    return rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_documents_of_one_row_group_make_several_tasks(spark):
    read = spark.read.parquet(f"{SF}/documents.parquet")
    assert held(read) == 10_000
    dealt = documents(spark, SF)
    assert dealt.rdd.getNumPartitions() == 5 and held(dealt) < 3_000
    assert dealt.exceptAll(read).count() == 0 and dealt.count() == read.count()


def test_texts_in_many_parts_do_not_move(spark, tmp_path):
    made = spark.range(9_000).withColumn("text", F.lit("x"))
    made.repartition(18, "id").write.parquet(str(tmp_path / "many"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a file a part
    try:
        kept = spread_texts(spark.read.parquet(str(tmp_path / "many")), "id", rows_per_task=100)
        assert "Repartition" not in kept._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert spread_texts(made.where("false"), "id").count() == 0
    assert spread_texts(made.limit(50), "id").count() == 50


@pytest.mark.parametrize("name", ["warning_similarity_documents", "extract_documents", "normalize_documents",
                                  "rule_extractors_documents", "warning_documents"])
def test_queries_on_single_documents_deal_them(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression [doc_id" in plan
