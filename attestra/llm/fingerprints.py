"""Document fingerprints by consistent weighted sampling, in built-in functions only.

Terms are the words between white space, weighted by how often they occur. For every sample a term
draws r and c from Gamma(2, 1) and b from [0, 1), by its hash alone. A weight w gives the step
t = floor(ln w / r + b) and the value ln c - r (t - b + 1); the sample of a text is its least value.
Two texts agree in a sample with a probability equal to the generalised Jaccard similarity of their
weights, sum of minima over sum of maxima. A value tells its term and step, so it is the sample.

The draws are quantiles looked up by bits of one hash per sample. Gamma quantiles have no closed
form, so they are computed by Newton steps, in ``BANKS`` tables whose quantiles lie between each
other's; a term uses the bank its hash names. The tables are of a fixed size, half a megabyte in all,
and are broadcast to the terms in an equi-join on the bank.

Defined cases: a null text is empty; an empty or blank text has an empty fingerprint, of likeness 1
to another empty one and 0 to others; null ids come after all others; rows of one id are told apart
by their text, equal rows each get their result, and the next document of the id before is the one
of them with the least hash; a single document is its own next; an empty table gives an empty
result. Only the id and the text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.llm.common import settle, text_or_empty

#: Samples of a fingerprint: likeness has a standard error of at most one sixteenth.
SAMPLES = 64
#: Bits of a quantile's place in its table, of b, and number of tables.
R_BITS, C_BITS, B_BITS = 10, 14, 24
BANKS = 4
#: Samples that one row of a term computes. More per row make code too large to be compiled well.
SAMPLES_PER_ROW = 8


def gamma_tables(spark: SparkSession, bits: int, log: bool, banks: int = BANKS) -> DataFrame:
    """``bank, table``: Gamma(2, 1) quantiles of the middles of ``banks * 2 ** bits`` equal parts, dealt out.

    Newton's method on ln(1 - F(x)) = ln(1 + x) - x for the upper half, on F itself below.
    """
    parts = banks << bits
    p = F.col("p")
    start = F.when(p < 0.5, F.sqrt(2 * p)).otherwise(1.7 - F.ln(1 - p))
    lower_step = lambda x: x - (1 - (1 + x) * F.exp(-x) - p) / (x * F.exp(-x))
    upper_step = lambda x: x - (F.ln(1 + x) - x - F.ln(1 - p)) / (1 / (1 + x) - 1)
    x = F.aggregate(F.sequence(F.lit(1), F.lit(25)), F.col("start"), lambda x, _: F.when(
        p < 0.5, lower_step(x)).otherwise(upper_step(x)))
    rows = spark.range(parts).withColumn("p", (F.col("id") + 0.5) / float(parts)).withColumn("start", start).select(
        "id", (F.col("id") % banks).alias("bank"), (F.ln(x) if log else x).alias("x"))
    return rows.groupBy("bank").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda s: s["x"]).alias("table"))


def sample_values(term: str, log_weight: str, sample: Column) -> Column:
    """The value of a term in one sample; null where the text does not have it."""
    bits = F.xxhash64(F.col(term), sample)
    r = F.col("r_table")[bits.bitwiseAND(F.lit((1 << R_BITS) - 1)).cast("int")]
    log_c = F.col("c_table")[F.shiftrightunsigned(bits, R_BITS).bitwiseAND(F.lit((1 << C_BITS) - 1)).cast("int")]
    b = F.shiftrightunsigned(bits, R_BITS + C_BITS).bitwiseAND(F.lit((1 << B_BITS) - 1)).cast("double") / float(1 << B_BITS)
    return log_c - r * (F.floor(F.col(log_weight) / r + b).cast("double") - b + 1.0)


def weighted_samples(words: DataFrame, keys: list[str], flags: list[str], samples: int) -> DataFrame:
    """``keys`` and, for each flag, the array ``<flag>_samples`` over the flagged words.

    ``words`` has a row per occurrence: the keys, ``word`` and a 0/1 column per flag. Partitioned
    by the keys beforehand, it is not shuffled again.
    """
    spark = words.sparkSession
    tables = settle(gamma_tables(spark, R_BITS, False).withColumnRenamed("table", "r_table").join(
        gamma_tables(spark, C_BITS, True).withColumnRenamed("table", "c_table"), "bank"))
    counted = words.groupBy(*keys, "word").agg(*[F.sum(f).alias(f) for f in flags])
    terms = counted.select(*keys, F.xxhash64("word").alias("term"), *[
        F.when(F.col(f) > 0, F.ln(F.col(f).cast("double"))).alias(f) for f in flags])
    blocks = F.array(*[F.lit(d) for d in range(0, samples, SAMPLES_PER_ROW)])
    terms = terms.withColumn("bank", F.pmod("term", F.lit(BANKS))).join(F.broadcast(tables), "bank").withColumn(
        "block", F.explode(blocks))
    least = terms.groupBy(*keys, "block").agg(*[
        F.min(sample_values("term", f, F.col("block") + d)).alias(f"{f}_{d}")
        for f in flags for d in range(SAMPLES_PER_ROW)])
    # The value itself is the sample; 32 bits of its hash are enough to compare.
    rows = [F.array(*[F.when(F.col(f"{f}_{d}").isNotNull(), F.hash(f"{f}_{d}")) for d in range(SAMPLES_PER_ROW)]).alias(f)
            for f in flags]
    whole = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", *rows))).alias("blocks"))
    return whole.select(*keys, *[F.flatten(F.col(f"blocks.{f}")).alias(f"{f}_samples") for f in flags])


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two fingerprints agree."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)
    return F.when(a[0].isNull() & b[0].isNull(), F.lit(1.0)).when(
        a[0].isNull() | b[0].isNull(), F.lit(0.0)).otherwise(same)


def as_text(samples: Column) -> Column:
    """Eight hexadecimal digits per sample; nothing for a text without words."""
    digits = F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(
        F.lit(0xFFFFFFFF))), 8, "0")))
    return F.when(samples[0].isNull(), F.lit("")).otherwise(F.array_join(digits, ""))


def next_ids(ids: DataFrame) -> DataFrame:
    """Add ``next_none, next_id`` to ``none, id``: the next in falling order, nulls last, then from the start.

    Ids are dealt out in ranges and written, so that a range keeps its number; the next of a
    range's last id is the first of the following range. There is one such row per range.
    """
    ranges = settle(ids.repartitionByRange(F.col("none"), F.col("id").desc()).withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy("none", F.col("id").desc())
    after = F.lead(F.struct(F.col("none").alias("none"), F.col("id").alias("id"))).over(inside)
    firsts = ranges.groupBy("range").agg(F.max(F.struct((~F.col("none")).alias("some"), "id")).alias("first"))
    across = Window.partitionBy(F.lit(1)).orderBy("range")
    firsts = firsts.select("range", F.coalesce(
        F.lead("first").over(across), F.first("first").over(across)).alias("following"))
    both = ranges.withColumn("after", after).join(firsts, "range")
    return both.withColumn("next_none", F.coalesce("after.none", ~F.col("following.some"))).withColumn(
        "next_id", F.coalesce("after.id", "following.id")).drop("range", "after", "following")


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, id_column: str = "doc_id",
                        text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they and the next one's are.

    In the edited text the last half (rounded down) of the code points is replaced by as many of
    the next document's first ones. ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    zero = F.lit(0).cast(id_type)
    named = docs.select(F.coalesce(F.col(id_column), zero).alias("id"), F.col(id_column).isNull().alias("none"),
                        text_or_empty(text_column).alias("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    ids = next_ids(named.groupBy("none", "id").agg(
        F.max(half).alias("half"), F.min(F.xxhash64("text")).alias("chosen"), F.count(F.lit(1)).alias("n")))
    ids = settle(ids)
    # Both uses of the dealt-out texts are one shuffle, so nothing here may add a key to the join.
    texts = named.repartition("none", "id")
    asked = ids.alias("d").join(ids.alias("n"), (F.col("d.next_none") == F.col("n.none")) & (
        F.col("d.next_id") == F.col("n.id"))).select(
        F.col("n.none").alias("none"), F.col("n.id").alias("id"), F.col("n.chosen").alias("chosen"),
        F.col("d.none").alias("for_none"), F.col("d.id").alias("for_id"), F.col("d.half").alias("needed"))
    heads = texts.join(asked, ["none", "id"]).where(
        F.xxhash64("text").bitwiseXOR(F.col("chosen")) == 0).select(
        F.col("for_none").alias("none"), F.col("for_id").alias("id"),
        F.substring(F.col("text"), F.lit(1), F.col("needed")).alias("head"))
    own, keys = texts, ["none", "id"]
    if ids.where("n > 1").limit(1).count():
        keys = ["none", "id", "key"]
        heads = heads.groupBy("none", "id").agg(F.first("head").alias("head"))
        own = texts.withColumn("key", F.xxhash64("text")).groupBy(*keys).agg(
            F.first("text").alias("text"), F.count(F.lit(1)).alias("rows"))
    kept = F.substring(F.col("text"), F.lit(1), F.char_length("text") - half)
    both = own.join(heads, ["none", "id"]).withColumn(
        "edited", F.concat(kept, F.substring(F.col("head"), F.lit(1), half)))

    which = F.explode(F.array(
        F.struct(F.lit(1).alias("plain"), F.lit(0).alias("changed"), F.col("text").alias("part")),
        F.struct(F.lit(0).alias("plain"), F.lit(1).alias("changed"), F.col("edited").alias("part"))))
    words = both.select(*keys, which.alias("p")).select(*keys, "p.plain", "p.changed", "p.part").select(
        *keys, "plain", "changed", F.explode(F.split(F.translate("part", "\t\n\u000b\f\r", "     "), " ")).alias("word")
    ).where("word <> ''")
    signed = weighted_samples(words, keys, ["plain", "changed"], samples)
    facts = both.select(*keys, F.char_length("text").cast("long").alias("n_chars"),
                        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        *(["rows"] if "key" in keys else []))
    signed = settle(facts.join(signed, keys, "left"))
    # The next document's samples go to the document before it.
    least = signed.join(ids.select("none", "id", "chosen"), ["none", "id"])
    least = least.where(F.col("key") == F.col("chosen")) if "key" in keys else least
    following = ids.select("none", "id", "next_none", "next_id").join(least.select(
        F.col("none").alias("next_none"), F.col("id").alias("next_id"), F.col("plain_samples").alias("next_samples")),
        ["next_none", "next_id"])
    out = signed.join(following.select("none", "id", "next_samples"), ["none", "id"])
    if "key" in keys:
        out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    return out.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        as_text(F.col("plain_samples")).alias("fingerprint"), as_text(F.col("changed_samples")).alias("edited_fingerprint"),
        likeness(F.col("plain_samples"), F.col("changed_samples")).alias("near_edited"),
        likeness(F.col("plain_samples"), F.col("next_samples")).alias("near_next"))
