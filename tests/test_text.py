import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from attestra.functions import extract, sanitize
from attestra.functions import text as tx

c = F.col


@pytest.mark.parametrize("raw, want", [
    ("  Crème\u00a0Brûlée\t`x` ", "creme brulee 'x'"), ("A–B—C’s", "abcs"), ("", ""), (None, ""),
    ("①ﬁ", "1fi")])
def test_normalize_text(one, raw, want):
    assert one(tx.normalize_text(c("t")), t=raw) == want


def test_match_form_and_phrase(one):
    assert one(tx.normalize_for_match(c("t")), t="Stone's  Throw/No-5") == "stone s throw no 5"
    assert one(tx.contains_phrase(c("t"), c("p")), t="The STONE'S-THROW wine", p="stone's throw") is True
    assert one(tx.contains_phrase(c("t"), c("p")), t="abc", p="") is False
    assert one(tx.contains_phrase(c("t"), c("p")), t="abc", p="é€".replace("é", "")) is True


@pytest.mark.parametrize("raw, want", [
    ("750 Milliliters", "750 ml"), ("1 liter", "1 l"), ("12 fl. oz.", "12 fl oz"),
    ("12 FLUID OUNCES", "12 fl oz"), ("750 m.l.", "750 ml")])
def test_net_contents(one, raw, want):
    assert one(tx.normalize_net_contents(c("t")), t=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("1.2.3%", "1.23"), ("no", ""), ("45 %", "45"), (".5.", ".5")])
def test_numeric_string(one, raw, want):
    assert one(tx.numeric_string(c("t")), t=raw) == want


def test_zero_counts_as_missing(one):
    assert one(tx.number_or_null(c("x")), x=0.0) is None
    assert one(tx.proof_from_abv(c("x")), x=0.0) is None
    assert one(tx.proof_from_abv(c("x")), x=45.0) == 90.0
    assert one(tx.parse_float(c("t")), t="0") == 0.0
    assert one(tx.values_close(c("x"), c("y"), 0.25), x=45.0, y=45.25) is True
    assert one(tx.values_close(c("x"), c("y"), 0.25), x=0.0, y=0.0) is False


@pytest.mark.parametrize("x, want", [
    (45.0, "45"), (41.5, "41.5"), (0.0, "0"), (100.0, "100"), (123456.0, "123456"),
    (1234567.0, "1.23457e+06"), (100000.0, "100000")])
def test_format_g(one, x, want):
    assert one(tx.format_g(c("x")), x=x) == want == f"{x:g}"


def test_context_is_cut_at_both_ends(one):
    text = "a" * 100 + " brand " + "b" * 100
    got = one(tx.extract_context(c("t"), c("p"), 10), t=text, p="BRAND")
    assert got == "a" * 9 + " brand " + "b" * 9
    assert one(tx.extract_context(c("t"), c("p")), t=text, p="missing") == ""


@pytest.mark.parametrize("raw, want", [
    ("45% ALC/VOL", 45.0), ("ALC. 45% BY VOL", None), ("40.5 abv", 40.5),
    ("13 % alcohol by volume", 13.0), ("0% abv", 0.0)])
def test_rule_abv(one, raw, want):
    assert one(extract.rule_abv(c("t")), t=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("1 liter", "1 l"), ("750 milliliters", "750 ml"), ("45 lbs", "45 l"), ("12 fl. oz.", ""),
    ("700 mL", "700 ml")])
def test_rule_net_contents_quirks(one, raw, want):
    assert one(extract.rule_net_contents(c("t")), t=raw) == want


LABEL = ("  OLD\tTOM \r\n\r\nPale Reserve\nALC. 45% BY VOL\nNET CONTENTS: 750  mL\x0bBOTTLED BY Old Tom\n"
         "COUNTRY OF ORIGIN:  Ireland \nGovernment Warning: be careful")


def test_extracted_fields(one):
    got = one(extract.extracted_fields(c("t")), t=LABEL).asDict()
    assert got == {
        "brand_name": "OLD TOM", "class_type": "Pale Reserve", "alcohol_content": 45.0,
        "net_contents": "750 mL", "producer_bottler": "BOTTLED BY Old Tom",
        "country_of_origin": "Ireland", "government_warning": "Government Warning: be careful"}
    assert one(extract.lines(c("t")), t=LABEL)[0:2] == ["OLD TOM", "Pale Reserve"]
    blank = one(extract.extracted_fields(c("t")), t="").asDict()
    assert blank["alcohol_content"] is None and set(v for v in blank.values() if v is not None) == {""}


def test_long_line_stays_linear(one):
    text = "x y z " * 20000  # one line without any keyword
    assert one(extract.extracted_fields(c("t")), t=text)["class_type"] == ""


@pytest.mark.parametrize("raw, want", [
    ("at C:\\Users\\x\\a.txt", "at [PATH]"), ("see /tmp/a/b.py, ok", "see [PATH], ok"),
    ("me@x.org", "[EMAIL]"), ("Password: abc next", "Password=[SECRET] next"),
    ("id 123E4567-e89b-12d3-a456-426614174000", "id [GUID]"), ("a\x00b\r\n c", "ab c"),
    ('"' + "q" * 130 + '"', '"[LONG_TEXT]"'), ("a, " * 120, "[MANIFEST_ROW]"),
    ("word " * 120, "[LONG_TEXT]"), (None, "")])
def test_sanitize(one, raw, want):
    assert one(sanitize.sanitize_text(c("t")), t=raw) == want


def test_sanitize_switches(one):
    kept = one(sanitize.sanitize_text(c("t"), 20, mask_paths=False, mask_long_text=False), t="/tmp/a " + "w, " * 200)
    assert kept == "/tmp/a w, w, w, w, w"[:20]


def test_needles_equal_brute_force(spark, tmp_path):
    import random

    from attestra.operators import needles

    rng = random.Random(3)
    words = ["ab", "abc", "bca", "ca", "Stone's", "x-ray", "été", "b", "---"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for k in range(120)]
    texts += [(120, None), (121, "   "), (122, "!!!"), (None, "ab bca"), (123, "ab ca"), (123, "ab ca"), (124, "ab " * 5000)]
    asked = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for k in range(60)]
    asked += [(60, None), (61, ""), (62, "?!"), (63, "b"), (64, "c a"), (65, "bc ab c"), (66, "no such words here"), (66, "ab"),
              (None, "ab bca")]
    frames = [spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id int, body string, word string, at int").repartition(3)
              for rows in (texts, asked)]
    left, right = frames[0].withColumnRenamed("id", "t"), frames[1].withColumnRenamed("id", "n")

    def form(x):
        kept = "".join(c for c in unicodedata.normalize("NFKD", x) if ord(c) < 128)
        return re.sub("[^a-z0-9]+", " ", kept.lower()).strip()

    want = sorted(str((i, j, form(t).find(form(p)) + 1)) for i, t in texts for j, p in asked
                  if t and p and form(p) in form(t))
    for store in (None, str(tmp_path / "forms")):
        found = needles.find_needles(left, right, "t", "body", "n", "body", store)
        assert found.columns == ["t", "n", "at"]
        assert sorted(str(tuple(r)) for r in found.collect()) == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert needles.find_needles(left.where("false"), right, "t", "body", "n", "body").count() == 0
    assert needles.find_needles(left, right.where("false"), "t", "body", "n", "body").count() == 0


def test_match_form_costs_about_one_plain_replacement(spark):
    """An alternation in the pattern takes Java some five times as long."""
    import time

    texts = spark.range(8_000).select(F.concat_ws(" ", F.col("id").cast("string"), F.repeat(
        F.lit("According to the Surgeon General, women should not drink. "), 100)).alias("t")).localCheckpoint()

    def least(column):
        seconds = []
        for _ in range(3):
            begin = time.perf_counter()
            texts.select(F.sum(F.length(column))).collect()
            seconds.append(time.perf_counter() - begin)
        return min(seconds)

    plain = least(F.regexp_replace(F.lower("t"), "[^a-z0-9]+", " "))
    assert least(tx.match_folded(c("t"))) < 2.5 * plain
    odd = ["", " ", "a  b", " - a-b_c ", "!\n?", "A1 . 2", "x y"]
    frame = spark.createDataFrame([(t,) for t in odd], "t string")
    assert [r.v for r in frame.select(tx.match_folded(c("t")).alias("v")).collect()] == [
        re.sub("[^a-z0-9]+", " ", t.lower()).strip() for t in odd]
