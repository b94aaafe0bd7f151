"""Latency against the service level: per label, per batch, acceptance and evidence.

Timings are a table ``(batch columns..., file_name, processing_seconds)``. Every function works
on one batch or, with ``by``, on many at once in a single aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.constants import (
    MET, NOT_EVALUATED, NOT_MET, PARTIALLY_EVALUATED, PASS, WARNING,
)
from attestra.schema import SlaOptions


def fixed(value: Column, digits: int) -> Column:
    """A number with fixed digits; the last bits of an interpolation do not decide a tie."""
    return F.format_string(f"%.{digits}f", F.round(value, 9))


def _rounded(name: str, digits: int) -> Column:
    """Rounded twice, so that the last bits of an interpolation do not decide a tie."""
    return F.round(F.round(name, 9), digits).alias(name)


def _clamped(seconds: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(seconds.cast("double"), F.lit(0.0)))


def label_timings(timings: DataFrame, options: SlaOptions = SlaOptions()) -> DataFrame:
    """Add the service-level verdict of each label."""
    sla = options.sla()
    seconds = _clamped(F.col("processing_seconds"))
    within = seconds <= sla
    text = F.concat(F.lit("Processed in "), fixed(seconds, 3))
    return timings.withColumns({
        "processing_seconds": seconds,
        "sla_seconds": F.lit(sla),
        "within_sla": within,
        "sla_breach_seconds": F.greatest(F.lit(0.0), seconds - sla),
        "sla_status": F.when(within, PASS).otherwise(WARNING),
        "performance_message": F.when(
            within, F.concat(text, F.lit(f" seconds, within the {sla:.3f}-second SLA."))
        ).otherwise(F.concat(text, F.lit(f" seconds, exceeding the {sla:.3f}-second SLA."))),
    })


def performance_table(timings: DataFrame, options: SlaOptions = SlaOptions()) -> DataFrame:
    """Presentation form of ``label_timings``."""
    rows = label_timings(timings, options)
    stamps = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n)
              for c, n in (("started_on", "Started On"), ("completed_on", "Completed On"))
              if c in timings.columns]
    return rows.select(
        F.col("file_name").alias("File Name"),
        F.round("processing_seconds", 3).alias("Processing Seconds"),
        F.round("sla_seconds", 3).alias("SLA Seconds"),
        F.col("within_sla").alias("Within SLA"),
        F.round("sla_breach_seconds", 3).alias("SLA Breach Seconds"),
        F.col("sla_status").alias("SLA Status"),
        F.col("performance_message").alias("Performance Message"), *stamps)


PERCENTS = (0.5, 0.9, 0.95)
#: Bits of a value that one round of the selection counts, and rounds over all 64.
DIGIT_BITS, ROUNDS = 16, 4


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe key equality: a missing batch id is a batch of its own."""
    return reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[c]) for c in names])


def ordered_bits(value: Column) -> Column:
    """A non-negative double's bits as a long: larger values have larger ones."""
    # The power of two at or below the value; a logarithm may be off by one next to powers of two.
    near = F.greatest(F.floor(F.log2(value)), F.lit(-1022)).cast("int")
    power = F.when(F.pow(F.lit(2.0), near) > value, near - 1).when(
        F.pow(F.lit(2.0), near + 1) <= value, near + 1).otherwise(near)
    power = F.greatest(power, F.lit(-1022))
    fraction = value / F.pow(F.lit(2.0), power)
    # Below the smallest normal number the leading bit is missing and the exponent counts as 0.
    normal = fraction >= 1.0
    bits = (power + 1023).cast("bigint") * F.lit(1 << 52) + ((fraction - 1.0) * float(1 << 52)).cast("bigint")
    return F.when(value == 0.0, F.lit(0).cast("bigint")).when(value == float("inf"), F.lit(0x7FF << 52)).when(
        normal, bits).otherwise((fraction * float(1 << 52)).cast("bigint"))


def exact_percentiles(values: DataFrame, by: list[str]) -> DataFrame:
    """Interpolated percentiles of distinct timings ``s`` that occur ``w`` times.

    Radix selection: each round counts the values of a batch by their next 16 bits and keeps those
    whose count reaches a wanted rank. A task orders at most 65,536 counts, whether a batch's values
    lie in one millisecond or are spread over months, and whatever share of all rows a batch has.
    """
    c = F.col
    digits = [f"_d{k}" for k in range(ROUNDS)]
    every = values.withColumn("_bits", ordered_bits(c("s"))).select(*by, "s", "w", *[
        F.shiftright("_bits", 64 - DIGIT_BITS * (k + 1)).bitwiseAND((1 << DIGIT_BITS) - 1).alias(d)
        for k, d in enumerate(digits)])
    ranks, places = "_ranks", [(c("n") - 1) * F.lit(p) for p in PERCENTS]
    wanted = []
    for place in places:
        low = F.floor(place).cast("bigint")
        wanted += [low, F.least(low + 1, c("n") - 1)]
    fixed: list[str] = []
    rows, found = every, None
    for digit in digits:
        # ``_first`` is the rank of the first value that shares the bits so far.
        before = F.lit(0).cast("bigint") if found is None else F.first("_first")
        counts = rows.groupBy(*by, *fixed, digit).agg(
            F.sum("w").alias("_w"), F.max("s").alias("s"), before.alias("_base"),
            *([] if found is None else [F.first(c(ranks)).alias(ranks), F.first("n").alias("n")]))
        group = Window.partitionBy(*by, *fixed)
        if found is None:
            counts = counts.withColumn("n", F.sum("_w").over(group)).withColumn(ranks, F.array_distinct(F.array(*wanted)))
        upto = c("_base") + F.sum("_w").over(group.orderBy(digit))
        fixed.append(digit)
        placed = counts.withColumn("_last", upto).withColumn("_first", c("_last") - c("_w")).withColumn(
            ranks, F.filter(ranks, lambda r: (r >= c("_first")) & (r < c("_last")))).where(F.size(ranks) > 0)
        found = placed.select(*by, *fixed, "s", "n", "_first", "_last", ranks)
        if digit != digits[-1]:
            next_ = found.select(*[c(k).alias(f"_k_{k}") for k in (*by, *fixed)], "n", "_first", ranks)
            keys = reduce(lambda x, y: x & y, [c(k).eqNullSafe(c(f"_k_{k}")) for k in by],
                          reduce(lambda x, y: x & y, [c(k) == c(f"_k_{k}") for k in fixed]))
            rows = every.join(next_, keys).select(*by, *digits, "s", "w", "n", "_first", ranks)
    # All 64 bits are fixed now: a row is one value and covers the ranks from _first up to _last.
    at = [F.max(F.when((r >= c("_first")) & (r < c("_last")), c("s"))) for r in wanted]
    picked = found.groupBy(*by).agg(F.first("n").alias("n"), *[v.alias(f"r{i}") for i, v in enumerate(at)])

    def blend(i, place):
        low, high = c(f"r{2 * i}"), c(f"r{2 * i + 1}")
        return (low + (high - low) * (place - F.floor(place))).alias(f"q{i}")

    return picked.select(*by, *[blend(i, p) for i, p in enumerate(places)])


def _values(timings: DataFrame, keys: tuple[str, ...], weight: str | None) -> DataFrame:
    """Different timings ``s`` of each batch and how often (``w``) they occur."""
    times = F.lit(1) if weight is None else F.col(weight)
    return timings.select(*keys, _clamped(F.col("processing_seconds")).alias("s"), times.cast("bigint").alias("w")).groupBy(
        *keys, "s").agg(F.sum("w").alias("w"))


def _summarized(values: DataFrame, by: tuple[str, ...], options: SlaOptions) -> DataFrame:
    sla = options.sla()
    zero, none = F.lit(0.0), F.lit(0).cast("bigint")
    measures = [
        F.coalesce(F.sum("w"), none).alias("n"),
        F.coalesce(F.sum(F.col("s") * F.col("w")), zero).alias("total_seconds"),
        F.coalesce(F.max("s"), zero).alias("maximum_seconds"),
        F.coalesce(F.min("s"), zero).alias("minimum_seconds"),
        F.coalesce(F.sum(F.when(F.col("s") <= sla, F.col("w"))), none)
        .alias("within_sla_count")]
    keys = list(by) or ["_all"]
    # A global aggregate gives its row for an empty table too.
    summed = values.groupBy(*by).agg(*measures) if by else values.agg(*measures).withColumn(
        "_all", F.lit(1))
    quantiles = exact_percentiles(values, keys)
    joined = summed.join(quantiles, _same(summed, quantiles, keys), "left").select(
        summed["*"], *[quantiles[f"q{i}"] for i in range(len(PERCENTS))])
    total = F.col("n")
    breaches = total - F.col("within_sla_count")
    half, ninety, high = (F.coalesce(f"q{i}", zero) for i in range(3))
    return joined.select(
        *by, total.alias("total_files"),
        F.when(total > 0, F.col("total_seconds") / total).otherwise(0.0)
        .alias("average_seconds"), "maximum_seconds", "minimum_seconds",
        half.alias("median_seconds"), half.alias("p50_seconds"),
        ninety.alias("p90_seconds"), high.alias("p95_seconds"),
        "within_sla_count", breaches.alias("sla_breach_count"),
        F.when(total > 0, breaches / total).otherwise(0.0).alias("sla_breach_rate"),
        F.lit(sla).alias("sla_seconds"), "total_seconds")


def timing_summary(timings: DataFrame, options: SlaOptions = SlaOptions(),
                   by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Counts, moments and interpolated percentiles, one row per batch.

    ``weight`` names a column that says how often a timing counts. Without ``by`` there is
    one row, also for no timings at all.
    """
    # Everything reads this one aggregation; its shuffle is planned once and reused.
    values = _values(timings if by else timings.withColumn("_all", F.lit(1)), by or ("_all",), weight)
    return _summarized(values, by, options)


def timing_rollup(timings: DataFrame, options: SlaOptions = SlaOptions(), by: tuple[str, ...] = ("batch_id",),
                  weight: str | None = None) -> DataFrame:
    """The summary of every batch and, from the same pass, of all timings together.

    ``level`` 0 has a row per batch, ``level`` 1 the row of all, whose batch columns are null. The
    timings are counted once; the two grouping sets share the counted values and the selection.
    """
    counted = _values(timings, by, weight)
    # Batch columns beside the grouping sets: a null batch id is not the null of the total.
    sets = counted.groupingSets([[*by, "s"], ["s"]], *by, "s").agg(
        F.sum("w").alias("w"), F.when(F.grouping_id() == 0, 0).otherwise(1).alias("level"))
    return _summarized(sets.select("level", *by, "s", "w"), ("level", *by), options)


def timing_acceptance(summary: DataFrame, options: SlaOptions = SlaOptions()) -> DataFrame:
    """Add the acceptance verdict to a timing summary."""
    c = F.col
    timed = c("total_files") > 0
    average = timed & (c("average_seconds") <= options.max_average_seconds)
    p95 = timed & (c("p95_seconds") <= options.max_p95_seconds)
    rate = timed & (c("sla_breach_rate") <= options.max_breach_rate)
    met = average & p95 & rate
    files = F.concat(c("total_files").cast("string"), F.lit(" timed label files. Average "))
    good = F.concat(
        F.lit("Performance acceptance met for "), files, fixed(c("average_seconds"), 3),
        F.lit("s and p95 "), fixed(c("p95_seconds"), 3),
        F.lit("s were within configured targets."))
    bad = F.concat(
        F.lit("Performance acceptance not met for "), files, fixed(c("average_seconds"), 3),
        F.lit(f"s target {options.max_average_seconds:.3f}s; p95 "),
        fixed(c("p95_seconds"), 3), F.lit(f"s target {options.max_p95_seconds:.3f}s; breach rate "),
        fixed(c("sla_breach_rate"), 4), F.lit(f" target {options.max_breach_rate:.4f}."))
    return summary.withColumns({
        "average_target_seconds": F.lit(float(options.max_average_seconds)),
        "p95_target_seconds": F.lit(float(options.max_p95_seconds)),
        "max_breach_rate": F.lit(float(options.max_breach_rate)),
        "meets_average_target": average,
        "meets_p95_target": p95,
        "meets_breach_rate_target": rate,
        "meets_acceptance": met,
        "acceptance_status":
            F.when(~timed, NOT_EVALUATED).when(met, MET).otherwise(NOT_MET),
        "acceptance_message": F.when(
            ~timed, "No timed label files were available for performance acceptance.")
        .when(met, good).otherwise(bad),
    })


def timing_evidence(accepted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Evidence flags and message from an accepted summary."""
    c = F.col
    tested = c("total_files") > 0
    count = F.concat(c("total_files").cast("string"), F.lit(" timed labels. Average "),
                     fixed(c("average_seconds"), 3))
    good = F.concat(F.lit("Performance evidence passed for "), count, F.lit("s and p95 "),
                    fixed(c("p95_seconds"), 3), F.lit("s were within configured targets."))
    bad = F.concat(F.lit("Performance evidence did not pass for "), count, F.lit("s, p95 "),
                   fixed(c("p95_seconds"), 3), F.lit("s, and breach rate "),
                   fixed(c("sla_breach_rate"), 4), F.lit(" should be reviewed."))
    return accepted.select(
        *by, tested.alias("sla_tested"),
        (tested & (c("sla_breach_count") == 0)).alias("under_five_seconds_per_label"),
        "meets_average_target", "meets_p95_target",
        c("meets_breach_rate_target").alias("meets_zero_breach_target"), "meets_acceptance",
        F.when(~tested, "No timed label files were available for performance evidence.")
        .when(c("meets_acceptance"), good).otherwise(bad).alias("message"))


def throughput(total: Column, seconds: Column) -> Column:
    """Labels per minute of summed processing time; parallelism is not credited."""
    return F.when((total > 0) & (seconds > 0), F.round(total / seconds * 60.0, 3)).otherwise(0.0)


def batch_acceptance(summary: DataFrame, options: SlaOptions = SlaOptions(),
                     by: tuple[str, ...] = ()) -> DataFrame:
    """Service level, batch size and overall verdict per batch."""
    c = F.col
    total = c("total_files")
    met = ((total > 0) & (c("average_seconds") <= options.max_average_seconds)
           & (c("p95_seconds") <= options.max_p95_seconds)
           & (c("sla_breach_rate") <= options.max_breach_rate))
    judged = summary.withColumns({
        "sla_acceptance": F.when(total == 0, NOT_EVALUATED).when(met, MET).otherwise(NOT_MET),
        "batch_size_acceptance": F.when(total < options.min_files, NOT_EVALUATED)
        .when(total <= options.max_files, MET).otherwise(NOT_MET)})
    sla, size = c("sla_acceptance"), c("batch_size_acceptance")
    overall = (
        F.when((sla == MET) & (size == MET), MET)
        .when((sla == MET) & (size == NOT_EVALUATED), PARTIALLY_EVALUATED)
        .when(sla == NOT_EVALUATED, NOT_EVALUATED).otherwise(NOT_MET))
    judged = judged.withColumn("overall_acceptance", overall)
    message = F.concat(
        F.lit("Overall acceptance: "), c("overall_acceptance"), F.lit(". Processed "),
        total.cast("string"), F.lit(" timed files. SLA acceptance: "), sla,
        F.lit(". Batch-size acceptance: "), size, F.lit("."))
    return judged.select(
        *by, total.alias("processed_files"), F.lit(options.min_files).alias("minimum_files"),
        F.lit(options.max_files).alias("maximum_files"),
        _rounded("average_seconds", 3),
        _rounded("median_seconds", 3),
        _rounded("p95_seconds", 3),
        _rounded("maximum_seconds", 3),
        _rounded("sla_seconds", 3),
        c("sla_breach_count").alias("sla_breaches"),
        _rounded("sla_breach_rate", 4),
        throughput(total, c("total_seconds")).alias("throughput_per_minute"),
        "sla_acceptance", "batch_size_acceptance", "overall_acceptance",
        message.alias("acceptance_message"))


def batch_summary(validation: DataFrame, acceptance: DataFrame,
                  skipped: DataFrame) -> DataFrame:
    """The flat batch record: 22 values from three one-row tables.

    ``skipped`` has one ``file_name`` row per distinct missing or extra file.
    """
    # count() turns a list of any length into one row before it meets the other two.
    skipped_count = skipped.agg(F.count("*").alias("skipped"))
    one = validation.join(F.broadcast(acceptance)).join(F.broadcast(skipped_count))
    c = F.col
    return one.select(
        c("processed_files").alias("Processed Files"), c("skipped").alias("Skipped Files"),
        c("is_valid").alias("Manifest Valid"), c("total_manifest_rows").alias("Manifest Rows"),
        c("total_uploaded_files").alias("Uploaded Files"),
        c("matched_files").alias("Matched Files"), c("missing_files").alias("Missing Files"),
        c("extra_files").alias("Extra Files"), c("average_seconds").alias("Average Seconds"),
        c("median_seconds").alias("Median Seconds"), c("p95_seconds").alias("P95 Seconds"),
        c("maximum_seconds").alias("Maximum Seconds"), c("sla_seconds").alias("SLA Seconds"),
        c("sla_breaches").alias("SLA Breaches"), c("sla_breach_rate").alias("SLA Breach Rate"),
        c("throughput_per_minute").alias("Throughput Labels Per Minute"),
        c("sla_acceptance").alias("SLA Acceptance"),
        c("batch_size_acceptance").alias("Batch Size Acceptance"),
        c("overall_acceptance").alias("Overall Acceptance"),
        c("acceptance_message").alias("Acceptance Message"),
        F.size("errors").alias("Errors"),
        (F.size("warnings") + c("extra_files")).alias("Warnings"))
