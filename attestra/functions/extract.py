"""Field extraction from label text: regular expressions and first-line scans.

``clean_lines`` turns the text into single-spaced, non-blank lines joined by newlines. Expressions that
ignore case cost ten times as much per letter as plain ones, so they run only on texts whose
``caseless`` form has the words they need, and first lines are found in that form alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.constants import (
    ABV_PATTERN, ALCOHOL_FIELD, BRAND_FIELD, CLASS_FIELD, CLASS_KEYWORDS, COUNTRY_FIELD,
    EXTRACT_ABV_PATTERNS, EXTRACT_COUNTRY_PHRASES, EXTRACT_NET_PATTERN,
    EXTRACT_PRODUCER_PHRASES, EXTRACT_WARNING_PATTERN, NET_FIELD, NET_PATTERN,
    NOT_BRAND_PHRASES, PRODUCER_FIELD, PROOF_PATTERN, WARNING_FIELD, WARNING_TEXT,
)
from attestra.functions.text import blank, collapse_spaces, net_contents_folded

ANY_CASE = "(?iU)"
# White space as ASCII knows it, and what other white space becomes; Java tests ASCII classes by a table.
_SPACE = r"\t-\r\x1c-\x20"
_OTHER_BREAKS = "\x85\u2028\u2029"
_OTHER_SPACES = "\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u202f\u205f\u3000"


def _either(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def clean_lines(text: Column) -> Column:
    """Non-blank, single-spaced lines joined by a newline. Most texts are so, but for their ends."""
    text = blank(text)
    odd = text.rlike(r"[\t\x0b-\r\x1c-\x1f\x80-\x{10ffff}]")
    for pair in ("  ", " \n", "\n ", "\n\n"):
        odd = odd | F.contains(text, F.lit(pair))
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(
        text, _OTHER_BREAKS + _OTHER_SPACES, "\n" * len(_OTHER_BREAKS) + " " * len(_OTHER_SPACES))).otherwise(text)
    joined = F.regexp_replace(plain, rf"[{_SPACE}]*[\n-\r\x1c-\x1e][{_SPACE}]*", "\n")
    spaced = F.regexp_replace(joined, r"[\t\x1f][\t\x1f ]*| [\t\x1f ]+", " ")
    return F.btrim(F.when(odd, spaced).otherwise(text), F.lit(" \n"))


def lines(text: Column) -> Column:
    """The same lines as an array."""
    cleaned = clean_lines(text)
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(
        F.split(cleaned, "\n"))


def brand_line(cleaned: Column) -> Column:
    """First line of three or more characters with none of the excluded phrases."""
    pattern = rf"(?imU)^(?![^\n]*(?:{_either(NOT_BRAND_PHRASES)}))[^\n]{{3,}}$"
    return F.regexp_extract(cleaned, pattern, 0)


def caseless(text: Column) -> Column:
    """Lower case, each letter in its place; beside the Kelvin sign, which lower case turns into k, three
    letters equal an ASCII letter in any case."""
    for letter, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def _once(value: Column, make) -> Column:
    """``make`` of a value that it reads several times; an element of an array is made once."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _has_any(folded: Column, words) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(folded, F.lit(word.lower()))
    return found


def _first_line_with(cleaned: Column, folded: Column | None, words) -> Column:
    """The caseless form has the same lines: those that begin before the first word tell which one it is."""
    folded = caseless(cleaned) if folded is None else folded
    words = [w.lower() for w in words]
    letters = "".join(sorted({w[0] for w in words}))
    before = F.regexp_replace(folded, rf"(?s)(?=[{letters}])(?:{_either(words)}).*", "")
    return F.when(_has_any(folded, words), F.split_part(
        cleaned, F.lit("\n"), F.size(F.split(before, "\n")))).otherwise("")


def class_line(cleaned: Column, folded: Column | None = None) -> Column:
    """First line with a class keyword anywhere in it, inside words too."""
    return _first_line_with(cleaned, folded, CLASS_KEYWORDS)


def producer_line(cleaned: Column, folded: Column | None = None) -> Column:
    return _first_line_with(cleaned, folded, EXTRACT_PRODUCER_PHRASES)


def country_of_line(cleaned: Column, folded: Column | None = None) -> Column:
    folded = caseless(cleaned) if folded is None else folded
    pattern = rf"(?iU)(?:{_either(EXTRACT_COUNTRY_PHRASES)}) *:? *([^\n]+)"
    return F.when(_has_any(folded, EXTRACT_COUNTRY_PHRASES),
                  F.trim(F.regexp_extract(cleaned, pattern, 1))).otherwise("")


def alcohol_content(text: Column, folded: Column | None = None) -> Column:
    folded = caseless(blank(text)) if folded is None else folded
    percent = F.contains(blank(text), F.lit("%"))
    found = [F.when(percent if "%" in p else F.contains(folded, F.lit("abv")), _once(
        F.regexp_extract(blank(text), ANY_CASE + p, 1), lambda v: F.when(v != "", v)))
             for p in EXTRACT_ABV_PATTERNS]
    return F.coalesce(*found).try_cast("double")


def net_contents(text: Column, folded: Column | None = None) -> Column:
    """The amount and unit are looked up once more in what was found, which is short."""
    folded = caseless(blank(text)) if folded is None else folded
    found = F.when(F.contains(folded, F.lit("content")),
                   F.regexp_extract(blank(text), ANY_CASE + EXTRACT_NET_PATTERN, 0)).otherwise("")
    part = [lambda v, k=k: F.regexp_extract(v, ANY_CASE + EXTRACT_NET_PATTERN, k) for k in (1, 2)]
    return _once(found, lambda v: F.when(v == "", "").otherwise(
        F.concat_ws(" ", part[0](v), collapse_spaces(part[1](v)))))


def government_warning(flat: Column) -> Column:
    """The standard text when it is there in any case, else from the prefix to the end.

    ``flat`` is single-spaced text, so a plain containment test spares the regular expression
    wherever there is no prefix.
    """
    return _once(F.struct(flat.alias("flat"), F.upper(flat).alias("upper")), lambda v: (
        F.when(~F.contains(v["upper"], F.lit("GOVERNMENT WARNING")), "")
        .when(F.contains(v["upper"], F.lit(WARNING_TEXT.upper())), WARNING_TEXT)
        .otherwise(F.trim(F.regexp_extract(v["flat"], ANY_CASE + EXTRACT_WARNING_PATTERN, 1)))))


def extracted_fields(text: Column, cleaned: Column | None = None) -> Column:
    """All seven structured fields as one struct."""
    cleaned = clean_lines(text) if cleaned is None else cleaned
    folded = caseless(cleaned)
    return F.struct(
        brand_line(cleaned).alias("brand_name"),
        class_line(cleaned, folded).alias("class_type"),
        alcohol_content(text, folded).alias("alcohol_content"),
        net_contents(text, folded).alias("net_contents"),
        producer_line(cleaned, folded).alias("producer_bottler"),
        country_of_line(cleaned, folded).alias("country_of_origin"),
        F.when(F.contains(folded, F.lit("government")), government_warning(
            F.replace(cleaned, F.lit("\n"), F.lit(" ")))).otherwise("").alias("government_warning"),
    )


def field_map(extracted: Column) -> Column:
    """Field name to extracted value; the ABV appears under two names."""
    abv = extracted["alcohol_content"].cast("string")
    pairs = (
        (BRAND_FIELD, extracted["brand_name"]), (CLASS_FIELD, extracted["class_type"]),
        (ALCOHOL_FIELD, abv), ("ABV", abv), (NET_FIELD, extracted["net_contents"]),
        (PRODUCER_FIELD, extracted["producer_bottler"]),
        (COUNTRY_FIELD, extracted["country_of_origin"]),
        (WARNING_FIELD, extracted["government_warning"]),
    )
    return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]),
                             F.array(*[v for _, v in pairs]))


def has_structured_field(extracted: Column) -> Column:
    texts = [extracted[c] != "" for c in (
        "brand_name", "class_type", "net_contents", "producer_bottler", "country_of_origin",
        "government_warning")]
    found = extracted["alcohol_content"].isNotNull()
    for one in texts:
        found = found | one
    return found


def rule_abv(text: Column) -> Column:
    """ABV as the rules read it; their pattern differs from the extractor's."""
    return F.regexp_extract(blank(text), ANY_CASE + ABV_PATTERN, 1).try_cast("double")


def rule_proof(text: Column) -> Column:
    return F.regexp_extract(blank(text), ANY_CASE + PROOF_PATTERN, 1).try_cast("double")


def rule_net_contents(text: Column) -> Column:
    amount = F.regexp_extract(blank(text), ANY_CASE + NET_PATTERN, 1)
    unit = F.regexp_extract(blank(text), ANY_CASE + NET_PATTERN, 2)
    return F.when(amount == "", "").otherwise(
        net_contents_folded(F.concat_ws(" ", amount, unit)))
