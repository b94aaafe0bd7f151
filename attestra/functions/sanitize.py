"""Masking of paths, addresses, identifiers, secrets and long payloads in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.constants import (
    DOUBLE_QUOTED_PAYLOAD, EMAIL, EMAIL_MARK, GUID, GUID_MARK, LONG_TEXT_MARK, MANIFEST_ROW_MARK, PATH_MARK,
    POSIX_PATH, SECRET, SECRET_MARK, SINGLE_QUOTED_PAYLOAD, TEMP_PATH, WINDOWS_PATH,
)
from attestra.functions.text import blank, strip


def sanitize_text(value: Column, max_length: int = 1000, mask_paths: bool = True,
                  mask_long_text: bool = True) -> Column:
    text = F.replace(blank(value.cast("string")), F.lit("\x00"), F.lit(""))
    text = F.regexp_replace(text, r"[\r\n\t]+", " ")
    text = strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]{2,}", " "))
    if mask_paths:
        text = F.regexp_replace(text, WINDOWS_PATH, PATH_MARK)
        text = F.regexp_replace(text, "(?U)" + POSIX_PATH, PATH_MARK)
        text = F.regexp_replace(text, "(?iU)" + TEMP_PATH, PATH_MARK)
    text = F.regexp_replace(text, "(?iU)" + EMAIL, EMAIL_MARK)
    text = F.regexp_replace(text, "(?iU)" + GUID, GUID_MARK)
    text = F.regexp_replace(text, "(?iU)" + SECRET, f"$1={SECRET_MARK}")
    if mask_long_text:
        text = F.regexp_replace(text, DOUBLE_QUOTED_PAYLOAD, f'"{LONG_TEXT_MARK}"')
        text = F.regexp_replace(text, SINGLE_QUOTED_PAYLOAD, f"'{LONG_TEXT_MARK}'")
        commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
        words = F.regexp_count(text, F.lit(r"(?U)\b[A-Za-z]{3,}\b"))
        text = (F.when((F.length(text) > 300) & (commas >= 5), MANIFEST_ROW_MARK)
                .when((F.length(text) > 500) & (words > 60), LONG_TEXT_MARK)
                .otherwise(text))
    return F.substring(text, 1, max_length)
