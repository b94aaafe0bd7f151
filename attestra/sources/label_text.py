"""Observed text: any table with a file name and its text becomes a label-text table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.constants import MANUAL_NOTE
from attestra.functions.text import base_name, blank, has_text
from attestra.sources.order import source_place


def label_text(texts: DataFrame, file_name: str = "file_name", raw_text: str = "raw_text",
               manual: bool = False) -> DataFrame:
    """Complete the columns the verification expects; given ones are kept.

    ``manual`` marks text that was supplied instead of recognized. ``row_id`` tells which of
    several uploads of a name is the last. Without it the last one is the last in its files, by
    path and place; a table that is not read from files has no such order, and a digest of the row
    stands in, so that the choice is the same however often and wherever the plan runs. Applied
    again, nothing changes.
    """
    have = set(texts.columns)
    engine = F.lit("manual" if manual else "")
    notes = F.array(F.lit(MANUAL_NOTE)) if manual else F.array().cast("array<string>")
    seconds = "ocr_seconds" if "ocr_seconds" in have else None
    place = None if "row_id" in have else source_place(texts)
    row_id = F.col("row_id") if "row_id" in have else place if place is not None else F.sha2(
        F.concat_ws("\x00", file_name, raw_text, *([seconds] if seconds else [])), 256)
    name = base_name(F.col(file_name))
    return texts.select(
        row_id.alias("row_id"),
        name.alias("file_name"),
        (F.col("file_type") if "file_type" in have
         else F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))).alias("file_type"),
        blank(F.col(raw_text)).alias("raw_text"),
        has_text(F.col(raw_text)).alias("has_text"),
        (F.col("ocr_engine") if "ocr_engine" in have else engine).alias("ocr_engine"),
        (F.coalesce(F.col("ocr_seconds"), F.lit(0.0)) if "ocr_seconds" in have and not manual
         else F.lit(0.0)).alias("ocr_seconds"),
        (F.coalesce(F.col("image_quality_notes"), F.array().cast("array<string>"))
         if "image_quality_notes" in have and not manual else notes)
        .alias("image_quality_notes"),
    )
