"""What the suffix-array search takes: memory of a shard, folders of the shorter windows."""

import os
import tracemalloc
import uuid

import numpy as np

from attestra.llm import common, suffix_array, suffix_dedup


def test_a_shard_takes_few_bytes_a_letter():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 101, 200_000).astype(np.uint8)
    text[150_000:150_300] = text[:300]
    tracemalloc.start()
    starts, again, _ = suffix_array.repeated_starts(text, np.full(1_000, 200), 150)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not hasattr(suffix_array, "common_prefixes")  # ranks up to the length say as much
    assert peak < 60 * len(text)
    assert starts[again].tolist() == [*range(0, 51), *range(150_000, 150_051)]


def test_settle_last_leaves_its_own_table_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda s: f"{tmp_path}/attestra-{uuid.uuid4().hex}")

    def make():
        once = common.settle(spark.range(10).toDF("n"))
        inner = common.settle_last(lambda: common.settle(once.selectExpr("n + 1 as n")))
        return common.settle_by(inner, "n").selectExpr("n * 2 as n")

    before = common.settle(spark.range(3).toDF("n"))
    done = common.settle_last(make)
    assert sorted(r["n"] for r in done.collect()) == list(range(2, 22, 2)) and before.count() == 3
    assert len(os.listdir(tmp_path)) == 2
    common.settle(done)
    assert len(os.listdir(tmp_path)) == 3


def test_shorter_windows_leave_one_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda s: f"{tmp_path}/attestra-{uuid.uuid4().hex}")
    seen = []
    within = suffix_dedup.repeated_within
    monkeypatch.setattr(suffix_dedup, "repeated_within", lambda *a: seen.append(os.listdir(tmp_path)) or within(*a))
    rows = [(k, f"{k} " * 30 + "the same passage in each of the texts " * 3 + f" {k}" * 30) for k in range(12)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 60, passage=40)
    assert out.count() == 12 and out.where("n_removed > 0").count() == 12
    assert [len(s) for s in seen] == [1]
