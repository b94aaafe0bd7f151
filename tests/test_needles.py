"""Few phrases are handed to the texts, which stay where they are; many meet them by joins. Both find the same."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import needles
from checks import QUERIES

SF = "/root/testdata/sf0.1"  # 10,000 documents in one row group
WORDS = ["a", "aa", "aaa", "aab", "stone", "stonewall", "ll s", "wallflower", "x", "12", "y z"]


def sentence(rng, most):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, most)))


def test_few_phrases_leave_texts_and_words_where_they_are(spark):
    texts = spark.createDataFrame([(k, f"word{k} of the text") for k in range(50)], "id int, body string")
    asked = spark.createDataFrame([(1, "of"), (2, "the text"), (3, "--"), (4, "word1")], "n int, phrase string")
    found = needles.find_needles(texts, asked, "id", "body", "n", "phrase")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("Exchange", "Join", "Generate"))
    assert found.count() == 3 * 50 + 11


def test_few_and_many_phrases_find_the_same(spark):
    rng = random.Random(5)
    bodies = [sentence(rng, 40) for _ in range(150)] + ["", None, "!?", "aa " * 3000 + "stonewall", "a a"]
    phrases = [sentence(rng, 6) for _ in range(80)] + ["--", None, "", "a", "a", "a" * 9, "stonewall stone", "stonewall stonewall x"]
    day = datetime.date(2024, 1, 1)
    texts = spark.createDataFrame([(f"t{k // 2}", b) for k, b in enumerate(bodies)], "t string, b string").repartition(3)
    asked = spark.createDataFrame([(day + datetime.timedelta(k), p) for k, p in enumerate(phrases)], "n date, p string")
    few, many = (needles.find_needles(texts, asked, "t", "b", "n", "p", few=n) for n in (needles.FEW, 0))
    assert few.schema.simpleString() == many.schema.simpleString() == "struct<t:string,n:date,at:int>"
    rows = [sorted(map(tuple, x.collect()), key=str) for x in (few, many)]
    assert rows[0] == rows[1] and len(rows[0]) > 1000


def test_phrases_with_all_letters_go_by_joins(spark, monkeypatch):
    monkeypatch.setattr(needles, "FEW_LETTERS", 5)
    texts = spark.createDataFrame([(1, "one two three")], "id int, body string")
    asked = spark.createDataFrame([(1, "two"), (2, "three")], "n int, phrase string")
    found = needles.find_needles(texts, asked, "id", "body", "n", "phrase")
    assert sorted(map(tuple, found.collect())) == [(1, 1, 5), (1, 2, 9)]
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("letters", [3, 50, 1 << 18])
def test_search_equals_find(monkeypatch, letters):
    monkeypatch.setattr(needles, "LETTERS", letters)
    rng = random.Random(letters)
    forms = ["", "a", "aa" * 200] + [sentence(rng, 30) for _ in range(100)]
    phrases = sorted({"", "a" * 8, "a" * 9, "a" * 17, "a" * 30, "a" * 401} | {sentence(rng, 12) for _ in range(200)}
                     | {f[k:k + n].strip() for f in forms for k in range(0, len(f), 7) for n in (1, 2, 3, 8, 9, 16, 25)})
    want = [{k: f.find(p) + 1 for k, p in enumerate(phrases) if p in f} for f in forms]
    assert needles.Phrases(phrases).search(forms) == want
    assert needles.Phrases([]).search(forms) == [{}] * len(forms)
    assert needles.Phrases(phrases).search([]) == []


def test_rows_leave_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(needles, "ROWS", 10)
    texts = spark.range(30).select("id", F.lit("b a").alias("body"))
    asked = spark.range(40).select(F.col("id").alias("n"), F.lit("A").alias("phrase"))
    found = needles.find_needles(texts, asked, "id", "body", "n", "phrase")
    assert found.count() == 1200 and found.distinct().count() == 1200 and found.where("at <> 3").count() == 0


@pytest.mark.parametrize("name", ["contains_needles", "contains_needles_short"])
def test_queries_deal_the_documents_they_search(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression [doc_id" in plan and "MapInArrow" in plan
