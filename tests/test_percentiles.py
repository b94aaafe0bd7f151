"""Exact percentiles by radix selection, and the summary of batches and all in one pass."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from attestra.operators import performance


def test_ordered_bits_are_those_of_the_double(spark):
    rng = np.random.default_rng(1)
    values = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 0.1, 1.0, np.nextafter(1, 0), np.nextafter(2, 0), 2.0,
              np.nextafter(2, 3), 8.0, np.nextafter(8, 0), 1e300, 1.7976931348623157e308, float("inf")]
    values = [float(v) for v in values] + [float(x) for x in np.exp(rng.uniform(-700, 700, 400))]
    values += [float(2.0 ** e) for e in range(-1060, 1023, 13)]
    out = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", performance.ordered_bits(F.col("v")).alias("b")).collect()
    assert [r["b"] for r in out] == [struct.unpack(">q", struct.pack(">d", r["v"]))[0] for r in out]


def summary_of(values):
    q = np.percentile(values, [50, 90, 95])
    return [len(values), *q]


def test_percentiles_of_narrow_wide_and_tied_batches(spark):
    rng = np.random.default_rng(2)
    batches = {
        "one millisecond": 1.0 + rng.random(3000) / 1000, "months": rng.random(2000) * 8e6, "ties": np.repeat([0.5, 2.0], [900, 100]),
        "tiny": rng.random(50) * 1e-12, "one": np.array([3.25]), "two": np.array([1.0, 2.0]), "zeros": np.zeros(7),
        None: np.exp(rng.uniform(-30, 30, 500))}
    rows = [(b, float(x)) for b, values in batches.items() for x in values]
    timings = spark.createDataFrame(rows, "batch_id string, processing_seconds double").repartition(5)
    columns = ["total_files", "median_seconds", "p90_seconds", "p95_seconds"]
    by = {r["batch_id"]: [r[c] for c in columns] for r in performance.timing_summary(timings, by=("batch_id",)).collect()}
    assert set(by) == set(batches)
    for b, values in batches.items():
        np.testing.assert_allclose(by[b], summary_of(values), rtol=1e-12)
    whole = performance.timing_summary(timings).first()
    np.testing.assert_allclose([whole[c] for c in columns], summary_of([x for _, x in rows]), rtol=1e-12)

    rolled = performance.timing_rollup(timings).collect()
    assert sorted(r["level"] for r in rolled) == [0] * len(batches) + [1]
    for r in rolled:
        values = batches[r["batch_id"]] if r["level"] == 0 else [x for _, x in rows]
        np.testing.assert_allclose([r[c] for c in columns], summary_of(values), rtol=1e-12)


def test_no_task_orders_the_values_of_a_batch(spark):
    timings = spark.createDataFrame([("a", 1.0)], "batch_id string, processing_seconds double")
    plan = performance.timing_summary(timings, by=("batch_id",))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # One per round, each ordered by the digit it counts, and one for the batch's size.
    assert len(windows) == performance.ROUNDS + 1
    assert all("[s#" not in line.split("windowspecdefinition")[-1] for line in windows)


def test_summaries_of_nothing(spark):
    nothing = spark.createDataFrame([], "batch_id string, processing_seconds double")
    assert performance.timing_summary(nothing, by=("batch_id",)).count() == 0
    assert performance.timing_summary(nothing).first()["total_files"] == 0
    nulls = spark.createDataFrame([("a", None), ("a", -3.0)], "batch_id string, processing_seconds double")
    assert performance.timing_summary(nulls).first()["p95_seconds"] == 0.0
