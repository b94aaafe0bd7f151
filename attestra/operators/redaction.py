"""Column and key redaction, raw-text notices, error-log rows and retention."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.constants import (
    LOG_FIELD_LIMITS, REDACTED, SAFE_KEYS, SAFE_WORDS, SENSITIVE_KEYS, SENSITIVE_WORDS,
    TEXT_NOTICE,
)
from attestra.functions.sanitize import sanitize_text
from attestra.schema import RetentionOptions


def _has(name: str, words, whole: bool) -> bool:
    if not whole:
        return any(w in name for w in words)
    spaced = f" {re.sub(r'[^a-z0-9]+', ' ', name).strip()} "
    return any(f" {w.replace('_', ' ')} " in spaced for w in words)


def is_sensitive_column(name: str, strict: bool = False) -> bool:
    """Safe words win over sensitive ones. They match anywhere inside the name, so some
    sensitive columns count as safe; ``strict`` compares whole words, sensitive ones first."""
    low = name.strip().lower()
    if strict:
        return _has(low, SENSITIVE_WORDS, True) or not _has(low, SAFE_WORDS, True)
    return not _has(low, SAFE_WORDS, False) and _has(low, SENSITIVE_WORDS, False)


def is_sensitive_key(name: str, strict: bool = False) -> bool:
    low = name.strip().lower()
    if strict:
        return low in SENSITIVE_KEYS or is_sensitive_column(name, True)
    if low in SAFE_KEYS or _has(low, SAFE_WORDS, False):
        return False
    return low in SENSITIVE_KEYS or _has(low, SENSITIVE_WORDS, False)


def redact_value(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    blank = ~text.rlike(r"(?U)[^\s\x1c-\x1f]") | (text == "NaN")
    return F.when(blank, "").otherwise(REDACTED)


def sensitive_columns(df: DataFrame, options: RetentionOptions = RetentionOptions()) -> list[str]:
    return [c for c in df.columns if is_sensitive_column(c, options.strict)]


def redact_table(df: DataFrame, options: RetentionOptions = RetentionOptions()) -> DataFrame:
    """Sensitive columns masked; unchanged when the policy allows exporting values."""
    if options.can_export_values:
        return df
    masked = set(sensitive_columns(df, options))
    return df.select(*[
        redact_value(F.col(f"`{c}`")).alias(c) if c in masked else F.col(f"`{c}`")
        for c in df.columns])


def redaction_audit(df: DataFrame, options: RetentionOptions = RetentionOptions()) -> DataFrame:
    """One row: whether redaction applied, to which columns, and why not."""
    fields = [] if options.can_export_values else sensitive_columns(df, options)
    if options.can_export_values:
        message = "Sensitive export is enabled; DataFrame was not redacted."
    elif fields:
        message = f"Redacted {len(fields)} sensitive DataFrame field(s)."
    else:
        message = "No sensitive DataFrame fields were detected."
    # limit(1) stops at the first row; the audit needs to know only whether there is one.
    rows = df.limit(1).agg(F.count("*").alias("n"))
    filled = F.col("n") > 0
    names = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    return rows.select(
        (filled & F.lit(bool(fields))).alias("redaction_applied"),
        F.when(filled, F.lit(len(fields))).otherwise(0).alias("redacted_field_count"),
        F.when(filled, names).otherwise(none).alias("redacted_fields"),
        F.when(filled, message).otherwise("DataFrame was empty; no redaction was required.")
        .alias("message"))


def _sensitive_map_key(key: Column, strict: bool) -> Column:
    """``is_sensitive_key`` for keys that are data."""
    low = F.lower(F.trim(key.cast("string")))
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^a-z0-9]+", " ")), F.lit(" "))

    def has(words, whole):
        found = [F.contains(spaced, F.lit(f" {w.replace('_', ' ')} ")) if whole
                 else F.contains(low, F.lit(w)) for w in words]
        return reduce(lambda x, y: x | y, found, F.lit(False))

    listed = low.isin(*SENSITIVE_KEYS)
    if strict:
        return listed | has(SENSITIVE_WORDS, True) | ~has(SAFE_WORDS, True)
    safe = low.isin(*SAFE_KEYS) | has(SAFE_WORDS, False)
    return ~safe & (listed | has(SENSITIVE_WORDS, False))


def _redact_map(value: Column, kind: T.MapType, options) -> Column:
    """Map values by their keys; a masked value of another type than text becomes null."""
    if isinstance(kind.valueType, T.StringType):
        def masked(v):
            return redact_value(v)
    elif isinstance(kind.valueType, (T.StructType, T.ArrayType, T.MapType)):
        def masked(v):
            return F.lit(None).cast(_redacted_type(kind.valueType, options))
    else:
        def masked(v):
            return F.lit(None).cast(kind.valueType)
    return F.transform_values(value, lambda k, v: F.when(
        _sensitive_map_key(k, options.strict), masked(v)).otherwise(
        _redact_nested(v, kind.valueType, options)))


def _redacted_type(kind: T.DataType, options) -> T.DataType:
    """The type ``_redact_nested`` gives: masked fields are text."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, T.StringType() if is_sensitive_key(
            f.name, options.strict) else _redacted_type(f.dataType, options)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_redacted_type(kind.elementType, options))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _redacted_type(kind.valueType, options))
    return kind


def _redact_field(value: Column, name: str, kind: T.DataType, options) -> Column:
    if is_sensitive_key(name, options.strict):
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.when(value.isNull(), "").otherwise(REDACTED)
        return redact_value(value)
    return _redact_nested(value, kind, options)


def _redact_nested(value: Column, kind: T.DataType, options) -> Column:
    if isinstance(kind, T.StructType):
        inner = F.struct(*[
            _redact_field(value[f.name], f.name, f.dataType, options).alias(f.name)
            for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _redact_nested(v, kind.elementType, options))
    if isinstance(kind, T.MapType):
        return _redact_map(value, kind, options)
    return value


def redact_nested(df: DataFrame, options: RetentionOptions = RetentionOptions()) -> DataFrame:
    """Mask sensitive keys at every depth of structs, arrays and maps, by a walk of the schema."""
    if options.can_export_values:
        return df
    return df.select(*[
        _redact_field(F.col(f"`{f.name}`"), f.name, f.dataType, options).alias(f.name)
        for f in df.schema.fields])


def raw_text_or_notice(text: Column, options: RetentionOptions = RetentionOptions()) -> Column:
    if options.can_export_raw_text:
        return F.coalesce(text, F.lit(""))
    return F.lit(TEXT_NOTICE)


def path_or_mask(path: Column, options: RetentionOptions = RetentionOptions()) -> Column:
    if options.can_export_paths:
        return path
    return F.when(path.isNotNull(), REDACTED)


def policy_flags(options: RetentionOptions = RetentionOptions()) -> dict[str, bool]:
    """The retention settings under the names the evidence checks read."""
    return {
        "NO_PERSISTENCE_MODE": options.no_persistence_mode,
        "LONG_TERM_STORAGE_DISABLED": options.long_term_storage_disabled,
        "ENABLE_UPLOAD_PERSISTENCE": options.upload_persistence_enabled,
        "ENABLE_RAW_TEXT_LOGGING": options.raw_text_logging_enabled,
        "ENABLE_RAW_OCR_EXPORT": options.raw_ocr_export_enabled,
        "ENABLE_EXTRACTED_DATA_EXPORT": options.extracted_data_export_enabled,
        "ENABLE_REDACTED_EVIDENCE_EXPORT": options.redacted_evidence_export_enabled,
        "ENABLE_FILE_PATH_EXPORT": options.file_path_export_enabled,
    }


def error_log_rows(errors: DataFrame) -> DataFrame:
    """Sanitized and length-limited log rows, ready to append."""
    return errors.select(
        "created_on", *[sanitize_text(F.col(c), n).alias(c)
                        for c, n in LOG_FIELD_LIMITS.items()])


def retained(log: DataFrame, as_of: dt.datetime, days: int = 7,
             column: str = "created_on") -> DataFrame:
    """Rows no older than ``days`` before ``as_of``; zero or fewer days keep everything.

    The cutoff is a literal of the column's own type, so the filter reaches the scan.
    """
    if days <= 0:
        return log
    cutoff = (as_of - dt.timedelta(days=days)).isoformat(sep=" ")
    return log.where(F.col(column) >= F.lit(cutoff).cast(log.schema[column].dataType))
