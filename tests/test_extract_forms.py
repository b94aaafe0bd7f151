"""Field extraction by caseless forms gives what the expressions without case gave on every text."""

import random

from pyspark.sql import functions as F

from attestra.constants import (
    CLASS_KEYWORDS, EXTRACT_ABV_PATTERNS, EXTRACT_COUNTRY_PHRASES, EXTRACT_NET_PATTERN, EXTRACT_PRODUCER_PHRASES,
)
from attestra.functions import extract
from attestra.functions.text import collapse_spaces

BREAK = r"\n\x0b\x0c\r\x1c-\x1e\x85  "


def either(words):
    return "|".join(w.replace(".", r"\.") for w in words)


def plain_clean(text):
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U)[\s\x1c-\x1f]*[{BREAK}][\s\x1c-\x1f]*", "\n")
    spaced = F.regexp_replace(
        joined, r"(?U)[[\s\x1c-\x1f]&&[^\n ]][[\s\x1c-\x1f]&&[^\n]]*| [[\s\x1c-\x1f]&&[^\n]]+", " ")
    return F.btrim(spaced, F.lit(" \n"))


def plain_line(cleaned, words):
    return F.regexp_extract(cleaned, rf"(?imU)^[^\n]*?(?:{either(words)})[^\n]*", 0)


def plain_fields(text, cleaned):
    text = F.coalesce(text, F.lit(""))
    abv = F.coalesce(*[F.nullif(F.regexp_extract(text, "(?iU)" + p, 1), F.lit("")) for p in EXTRACT_ABV_PATTERNS])
    amount, unit = (F.regexp_extract(text, "(?iU)" + EXTRACT_NET_PATTERN, k) for k in (1, 2))
    country = rf"(?iU)(?:{either(EXTRACT_COUNTRY_PHRASES)}) *:? *([^\n]+)"
    return F.struct(
        extract.brand_line(cleaned).alias("brand_name"), plain_line(cleaned, CLASS_KEYWORDS).alias("class_type"),
        abv.try_cast("double").alias("alcohol_content"),
        F.when(amount == "", "").otherwise(F.concat_ws(" ", amount, collapse_spaces(unit))).alias("net_contents"),
        plain_line(cleaned, EXTRACT_PRODUCER_PHRASES).alias("producer_bottler"),
        F.trim(F.regexp_extract(cleaned, country, 1)).alias("country_of_origin"),
        extract.government_warning(F.translate(cleaned, "\n", " ")).alias("government_warning"))


WORDS = (
    "Bottled by", "BOTTLED BY", "produced  in", "whıskey", "WHİSKY", "whisKy", "ſtout", "ﬆout", "straße", "gin", "al", "e",
    "Σ", "ΟΔΟΣ", "😀", "é", "Net Contents: 750 ml", "net content 1.5 FL. OZ", "CONTENTS : 12 l", "40% alc/vol", "45 abv", "٤٠ ABV",
    "ALC. 12.5 % by vol", "%", "abv", "Made in: France", "product of", "COUNTRY OF ORİGİN: x", "Government", "GOVERNMENT WARNING: no",
    "government warnıng x", "\n", "\r\n", " ", "\x85", "\x1c", "\x1f", "\t", " ", "  ", "　", "\x00", "a", "B", "")


def test_fields_equal_expressions_without_case(spark):
    rng = random.Random(5)
    texts = [None, "", " \n ", *WORDS] + ["".join(rng.choice(WORDS) + rng.choice(("", " ", " ", "\n")) for _ in range(rng.randint(
        1, 14))) for _ in range(3_000)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    t = F.col("t")
    rows = rows.withColumn("old", plain_clean(t)).withColumn("new", extract.clean_lines(t))
    assert [r["t"] for r in rows.where("old <> new").collect()] == []
    both = rows.select("t", plain_fields(t, F.col("old")).alias("old"), extract.extracted_fields(t, F.col("new")).alias("new"))
    assert [(r["t"], r["old"], r["new"]) for r in both.where(~F.col("old").eqNullSafe(F.col("new"))).collect()] == []


def test_each_letter_equals_as_without_case(spark):
    letters = [(chr(c),) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame(letters, "c string").withColumn("l", extract.caseless(F.col("c")))
    assert rows.where(F.length("l") != 1).count() == 0
    wrong = rows.where(F.col("c").rlike("(?iU)^[a-z]$") != F.col("l").rlike("^[a-z]$"))
    assert wrong.count() == 0
    assert rows.where("l rlike '^[a-z]$'").count() == 26 * 2 + 4


def test_expressions_without_case_wait_for_their_words(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(extract.extracted_fields(F.col("t")))
    text = plan._jdf.queryExecution().analyzed().toString().lower()
    assert "contains" in text and "(?imu)^[^\\n]*?" not in text
