"""Manifest CSV files: encoding probe, header names, required columns, typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.constants import (
    HEADER_ALIASES, MISSING_TOKENS, OPTIONAL_COLUMNS, REQUIRED_COLUMNS, SPIRITS, TRUE_TOKENS,
)
from attestra.functions.text import strip
from attestra.sources.order import FILE, PART, ROW, numbered, placed

# Code page 1252 equals Latin-1 but for these byte values; Spark reads only the latter.
_C1 = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_C1_LATIN = "".join(map(chr, _C1))
_C1_WINDOWS = bytes(_C1).decode("cp1252")
_BY_ALIAS = {alias: name for name, aliases in HEADER_ALIASES.items() for alias in aliases}


def probe_encodings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file with the first encoding of the chain that decodes all of it.

    The text reader hands over raw bytes line by line, so large files are probed in splits.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("value"))
    # The five byte values that code page 1252 leaves undefined.
    undefined = F.hex(F.col("value").cast("binary")).rlike("^(?:..)*(?:81|8D|8F|90|9D)")
    flags = lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(undefined).alias("undefined"))
    return flags.select("path", F.when(F.col("utf8"), "UTF-8").when(
        ~F.col("undefined"), "windows-1252").otherwise("ISO-8859-1").alias("encoding"))


def read_manifest_csv(spark: SparkSession, paths: str | list[str],
                      multi_line: bool = True) -> DataFrame:
    """Raw string columns under canonical names plus ``row_id``: files by path, rows as they stand there.

    ``multi_line`` keeps quoted line breaks but reads a file in one task; switch it off for
    large manifests without such values, which Spark then splits.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    by_encoding: dict[str, list[str]] = {}
    for row in probe_encodings(spark, wanted).toLocalIterator():  # one row per manifest file
        by_encoding.setdefault(row["encoding"], []).append(row["path"])
    frames = []
    for encoding, files in sorted(by_encoding.items()):
        frame = spark.read.csv(
            sorted(files), header=True, inferSchema=False, multiLine=multi_line, quote='"',
            escape='"', encoding="UTF-8" if encoding == "UTF-8" else "ISO-8859-1",
            enforceSchema=False)
        if encoding == "windows-1252":
            swap = str.maketrans(_C1_LATIN, _C1_WINDOWS)
            frame = placed(frame).select(*[
                F.translate(F.col(f"`{c}`"), _C1_LATIN, _C1_WINDOWS).alias(c.translate(swap))
                for c in frame.columns], FILE, PART, ROW)
        else:
            frame = placed(frame)
        names = canonical_columns(frame.drop(FILE, PART, ROW)).columns
        frames.append(frame.toDF(*names, FILE, PART, ROW))
    if not frames:
        return spark.createDataFrame([], "row_id bigint")
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return numbered(merged)


def canonical_name(header: str) -> str:
    key = " ".join(header.lstrip("\ufeff").strip().lower().replace("-", " ")
                   .replace("_", " ").split())
    return _BY_ALIAS.get(key, key.replace(" ", "_"))


def canonical_columns(df: DataFrame) -> DataFrame:
    names = [canonical_name(c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"Manifest headers map to the same column: {', '.join(clash)}")
    return df.toDF(*names)


def required_column_errors(df: DataFrame) -> list[str]:
    """Schema check only; an empty manifest is reported by ``manifest_errors``."""
    return [f"Missing required manifest column: {c}"
            for c in REQUIRED_COLUMNS if c not in df.columns]


def manifest_errors(df: DataFrame) -> list[str]:
    if not df.columns or df.isEmpty():
        return ["Manifest is empty or could not be read."]
    return required_column_errors(df)


def _present(value: Column) -> Column:
    """The cell, or null for a missing-value token."""
    return F.when(~value.isin(*MISSING_TOKENS), value)


def text_value(value: Column) -> Column:
    return F.coalesce(strip(_present(value)), F.lit(""))


def bool_value(value: Column) -> Column:
    return F.coalesce(F.lower(strip(_present(value))).isin(*TRUE_TOKENS), F.lit(False))


def float_value(value: Column) -> Column:
    bare = F.translate(strip(_present(value)), "%,", "")
    return bare.try_cast("double")


def typed_manifest(raw: DataFrame) -> DataFrame:
    """Typed expected records from raw string columns; absent optional columns are blank."""
    def cell(name):
        return F.col(name).cast("string") if name in raw.columns else F.lit(None).cast("string")

    beverage = text_value(cell("beverage_type"))
    columns = {
        "file_name": text_value(cell("file_name")),
        "brand_name": text_value(cell("brand_name")),
        "class_type": text_value(cell("class_type")),
        "beverage_type": F.when(beverage == "", SPIRITS).otherwise(beverage),
        "alcohol_content": float_value(cell("alcohol_content")),
        "proof": float_value(cell("proof")),
        "net_contents": text_value(cell("net_contents")),
        "producer_bottler": text_value(cell("producer_bottler")),
        "imported": bool_value(cell("imported")),
    }
    for name in OPTIONAL_COLUMNS[2:]:
        columns[name] = text_value(cell(name))
    lead = ["row_id"] if "row_id" in raw.columns else []
    return raw.select(*lead, *[v.alias(k) for k, v in columns.items()])


def load_manifest(spark: SparkSession, paths: str | list[str],
                  multi_line: bool = True) -> DataFrame:
    """Read, check and type a manifest; raises when required columns are missing."""
    raw = read_manifest_csv(spark, paths, multi_line)
    errors = required_column_errors(raw)
    if errors:
        raise ValueError("; ".join(errors))
    return typed_manifest(raw)
