"""Text, number and unit normalization as column expressions.

Only one step needs Python: folding non-ASCII text (compatibility decomposition, then dropping
what is left outside ASCII). It is an Arrow UDF that receives nulls for pure-ASCII values, so
those cost nothing. All functions treat null as the empty string.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from attestra.constants import ABV_REPLACEMENTS, CAPS_PREFIX_PATTERN, NET_REPLACEMENTS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Unicode white space plus the four ASCII separators that Java leaves out.
# A lone space, the usual case, becomes itself and is no match.
SPACES = r"(?U)[[\s\x1c-\x1f]&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"
ASCII_SPACES = SPACES.removeprefix("(?U)")
#: The same white space, character by character.
STRIPPED = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


@F.pandas_udf(StringType())
def _fold_udf(value: pd.Series) -> pd.Series:
    return value.map(
        lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii"),
        na_action="ignore",
    )


# Catalyst inlines a column built on a Python UDF into every expression that feeds another
# Python UDF, repeating its work. It never inlines a nondeterministic one, so plans that go on
# to a second UDF fold with this variant.
_fold_pinned_udf = F.pandas_udf(_fold_udf.func, StringType()).asNondeterministic()


def blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _replace_in_order(value: Column, pairs) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def fold_ascii(value: Column, pinned: bool = False) -> Column:
    value = blank(value)
    fold = _fold_pinned_udf if pinned else _fold_udf
    return F.coalesce(fold(F.when(value.rlike(r"[^\x00-\x7F]"), value)), value)


def collapse_spaces(value: Column) -> Column:
    return F.trim(F.regexp_replace(blank(value), SPACES, " "))


def strip(value: Column) -> Column:
    return F.btrim(blank(value), F.lit(STRIPPED))


def fold_apostrophes(value: Column) -> Column:
    """Backtick to apostrophe; curly quotes, en and em dashes are gone once ``fold_ascii`` ran."""
    return F.translate(blank(value), "`", "'")


def normalize_folded(folded: Column) -> Column:
    """``normalize_text`` for a value that ``fold_ascii`` already produced."""
    lowered = F.lower(F.translate(folded, "`", "'"))
    return F.trim(F.regexp_replace(lowered, ASCII_SPACES, " "))


def match_folded(folded: Column) -> Column:
    """``normalize_for_match`` for a value that ``fold_ascii`` already produced.

    One class and no alternation: Java tries the branches of one at every letter, which takes five
    times as long as replacing lone spaces by themselves.
    """
    return F.trim(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", " "))


def normalize_text(value: Column) -> Column:
    return normalize_folded(fold_ascii(value))


def normalize_for_match(value: Column) -> Column:
    return match_folded(fold_ascii(value))


# Brand, class and warning wording all compare in the same normal form.
normalize_for_strict_warning = normalize_for_match


def net_contents_folded(folded: Column) -> Column:
    replaced = _replace_in_order(normalize_folded(folded), NET_REPLACEMENTS)
    return F.trim(F.regexp_replace(replaced, ASCII_SPACES, " "))


def normalize_net_contents(value: Column) -> Column:
    return net_contents_folded(fold_ascii(value))


def normalize_abv_text(value: Column) -> Column:
    replaced = _replace_in_order(normalize_text(value), ABV_REPLACEMENTS)
    return F.trim(F.regexp_replace(replaced, ASCII_SPACES, " "))


def numeric_string(value: Column) -> Column:
    """Digits and dots only; the first dot stays, later ones are dropped."""
    kept = F.regexp_replace(normalize_text(value), r"[^0-9.]", "")
    head = F.substring_index(kept, ".", 1)
    tail = F.replace(F.substr(kept, F.length(head) + 2), F.lit("."), F.lit(""))
    return F.when(F.contains(kept, F.lit(".")), F.concat(head, F.lit("."), tail)).otherwise(kept)


def parse_float(value: Column) -> Column:
    return numeric_string(value).try_cast("double")


def number_or_null(value: Column) -> Column:
    """A numeric expected value: zero counts as not given."""
    return F.nullif(value.cast("double"), F.lit(0.0))


def proof_from_abv(abv: Column) -> Column:
    return number_or_null(abv) * 2.0


def values_close(left: Column, right: Column, tolerance: float) -> Column:
    """Absolute difference within tolerance; false when any operand is null or zero."""
    close = ((left != 0) & (right != 0) & F.lit(tolerance != 0)
             & (F.abs(left - right) <= F.lit(float(tolerance))))
    return F.coalesce(close, F.lit(False))


def contains_phrase(text: Column, phrase: Column) -> Column:
    both = (F.length(blank(text)) > 0) & (F.length(blank(phrase)) > 0)
    return both & F.contains(normalize_for_match(text), normalize_for_match(phrase))


def has_caps_prefix(text: Column) -> Column:
    return blank(text).rlike("(?U)" + CAPS_PREFIX_PATTERN)


def clean_artifacts(value: Column) -> Column:
    """Drop scanner artefacts: pipes and runs of ``_ ~ ^`` become spaces."""
    return collapse_spaces(F.regexp_replace(F.translate(blank(value), "|", " "), "[_~^]+", " "))


def normalize_label_text(value: Column) -> Column:
    return normalize_text(clean_artifacts(value))


def context_of(text: Column, phrase: Column, window: int = 80) -> Column:
    """Text around the first occurrence of a phrase; both sides already normalized."""
    at = F.position(phrase, text)
    start = F.greatest(at - 1 - F.lit(window), F.lit(0))
    end = F.least(F.length(text), at - 1 + F.length(phrase) + F.lit(window))
    return F.when(at > 0, F.trim(F.substr(text, start + 1, end - start))).otherwise("")


def extract_context(text: Column, phrase: Column, window: int = 80) -> Column:
    both = (F.length(blank(text)) > 0) & (F.length(blank(phrase)) > 0) & F.lit(window != 0)
    # Elements of an array are made once, however often the function reads them.
    forms = F.array(F.struct(normalize_text(text).alias("text"), normalize_text(phrase).alias("phrase")))
    found = F.get(F.transform(forms, lambda f: context_of(f["text"], f["phrase"], window)), F.lit(0))
    return F.when(both, found).otherwise("")


def base_name(path: Column) -> Column:
    """Last path segment; trailing slashes do not count."""
    return F.element_at(F.split(F.rtrim(blank(path), F.lit("/")), "/"), -1)


def has_text(value: Column) -> Column:
    return blank(value).rlike(r"(?U)[^\s\x1c-\x1f]")


def parse_optional_float(value: Column) -> Column:
    """Form input: percent signs removed, blank or unreadable is null."""
    return strip(F.replace(blank(value), F.lit("%"), F.lit(""))).try_cast("double")


def format_g(value: Column) -> Column:
    """Six significant digits without padding zeros, as ``%g`` prints them."""
    text = F.format_string("%.6g", value.cast("double"))
    text = F.regexp_replace(text, r"(\.\d*?)0+($|e)", "$1$2")
    return F.when(value.isNotNull(), F.regexp_replace(text, r"\.($|e)", "$1"))
