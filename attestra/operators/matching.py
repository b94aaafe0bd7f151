"""Matching manifest rows with uploaded files by name.

Names repeat: a single name may own a large share of either side. Both sides are therefore
aggregated by name first (partial aggregation absorbs repeats before the shuffle) and joined on
unique keys. Texts join by their unique row id, so a hot name never gathers texts in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.schema import Application


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def manifest_names(manifest: DataFrame) -> DataFrame:
    """Distinct manifest names with occurrences and first row id; blank names left out."""
    return (
        manifest.where(F.trim("file_name") != "")
        .select(name_key(F.col("file_name")).alias("key"), "file_name", "row_id")
        .groupBy("key", "file_name")
        .agg(F.count("*").alias("occurrences"), F.min("row_id").alias("first_row")))


def upload_names(files: DataFrame) -> DataFrame:
    return (
        files.select(name_key(F.col("file_name")).alias("key"), "file_name")
        .groupBy("key", "file_name").agg(F.count("*").alias("occurrences")))


def _keys(names: DataFrame) -> DataFrame:
    return names.select("key").distinct()


def matched_names(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest names with an upload, whatever the case, with their occurrences."""
    return manifest_names(manifest).join(
        _keys(upload_names(files)), "key", "left_semi").select("file_name", "occurrences")


def missing_names(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest names without an upload."""
    return manifest_names(manifest).join(
        _keys(upload_names(files)), "key", "left_anti").select("file_name", "occurrences")


def extra_names(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Uploads without a manifest row."""
    return upload_names(files).join(
        _keys(manifest_names(manifest)), "key", "left_anti").select("file_name", "occurrences")


def duplicate_names(manifest: DataFrame) -> DataFrame:
    """Every name, as written, of a second or later occurrence of the same key."""
    first = F.min("first_row").over(Window.partitionBy("key"))
    return (
        manifest_names(manifest)
        .withColumn("key_first", first)
        .where((F.col("occurrences") > 1) | (F.col("first_row") > F.col("key_first")))
        .select("file_name"))


def last_records(manifest: DataFrame) -> DataFrame:
    """The last manifest row of each key, with ``key`` and ``occurrences``."""
    last = (
        manifest.where(F.trim("file_name") != "")
        .select(name_key(F.col("file_name")).alias("key"), "row_id")
        .groupBy("key").agg(F.max("row_id").alias("row_id"),
                            F.count("*").alias("occurrences")))
    return manifest.join(last, "row_id")


def last_uploads(files: DataFrame) -> DataFrame:
    """Row id and name of the last upload of each key and how many there were; no text is moved."""
    return (
        files.select(name_key(F.col("file_name")).alias("key"), "file_name", "row_id")
        .where(F.col("key") != "")
        .groupBy("key").agg(F.max("row_id").alias("upload_row"),
                            F.max_by("file_name", "row_id").alias("upload_name"),
                            F.count("*").alias("uploads")))


def duplicate_upload_warnings(files: DataFrame) -> DataFrame:
    """One warning per upload name that came more than once."""
    return last_uploads(files).where(F.col("uploads") > 1).select(
        F.concat(F.lit("Duplicate uploaded file name encountered: "), F.col("upload_name"))
        .alias("warning"), (F.col("uploads") - 1).alias("times"))


def extra_upload_warnings(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return extra_names(manifest, files).select(
        F.concat(F.lit("Uploaded file did not have a matching manifest row and was skipped: "),
                 F.col("file_name")).alias("warning"), F.col("occurrences").alias("times"))


def validation_record(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """One row: counts, errors, warnings and validity of manifest against uploads.

    The name lists themselves are tables (``matched_names`` and so on), not arrays in a row.
    """
    names = manifest_names(manifest)
    by_key = names.groupBy("key").agg(
        F.sum("occurrences").alias("rows"),
        # All names of a key are repeats but the one that came first, if it came once.
        (F.count("*") - F.when(F.min_by("occurrences", "first_row") == 1, 1).otherwise(0))
        .alias("repeats"))
    uploads = files.select(name_key(F.col("file_name")).alias("key")).groupBy("key").agg(
        F.count("*").alias("files"))
    both = by_key.join(uploads, "key", "full_outer")
    zero = F.lit(0).cast("bigint")

    def total(value):
        return F.coalesce(F.sum(value), zero)

    counted = both.agg(
        total(F.when(F.col("files").isNotNull(), F.col("rows"))).alias("matched_files"),
        total(F.when(F.col("files").isNull(), F.col("rows"))).alias("missing_files"),
        total(F.when(F.col("rows").isNull(), F.col("files"))).alias("extra_files"),
        total(F.col("repeats")).alias("duplicate_manifest_files"),
        total(F.col("files")).alias("total_uploaded_files"))
    rows = manifest.agg(F.count("*").alias("total_manifest_rows"))
    record = counted.join(F.broadcast(rows))  # one row each
    c = F.col
    supplied = (c("total_manifest_rows") > 0) & (c("total_uploaded_files") > 0)

    def message(text, column):
        return F.when(c(column) > 0, F.concat(F.lit(text), c(column).cast("string")))

    errors = F.array_compact(F.array(
        message("Manifest rows without uploaded label files: ", "missing_files"),
        message("Duplicate manifest file names: ", "duplicate_manifest_files")))
    warnings = F.array_compact(F.array(
        message("Uploaded label files without manifest rows: ", "extra_files")))
    refused = F.array(F.lit(
        "Manifest/file validation failed: manifest rows and uploaded files are required."))
    none = F.array().cast("array<string>")
    counts = ("matched_files", "missing_files", "extra_files", "duplicate_manifest_files")
    totals = ("total_manifest_rows", "total_uploaded_files")
    return record.select(
        (supplied & (F.size(errors) == 0)).alias("is_valid"),
        *[F.when(supplied, c(t)).otherwise(zero).alias(t) for t in totals],
        *[F.when(supplied, c(n)).otherwise(zero).alias(n) for n in counts],
        F.when(supplied, errors).otherwise(refused).alias("errors"),
        F.when(supplied, warnings).otherwise(none).alias("warnings"))


def exact_name_match(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Case-sensitive pre-check: every distinct name and whether both sides have it."""
    left = manifest.where(F.col("file_name") != "").select("file_name").distinct().withColumn(
        "expected", F.lit(True))
    right = files.select("file_name").distinct().withColumn("uploaded", F.lit(True))
    both = left.join(right, "file_name", "full_outer")
    return both.select(
        "file_name",
        F.when(F.col("expected") & F.col("uploaded"), "matched")
        .when(F.col("expected"), "missing").otherwise("extra").alias("state"))


def has_minimum_application(application: Application | None) -> bool:
    if application is None:
        return False
    needed = (application.brand_name, application.class_type, application.alcohol_content,
              application.net_contents, application.producer_bottler,
              application.government_warning)
    return all(v is not None and str(v).strip() for v in needed)


def readiness(manifest: DataFrame | None, files: DataFrame,
              application: Application | None = None) -> DataFrame:
    """One row saying whether a run can start, in which mode, and why not."""
    minimum = F.lit(has_minimum_application(application))
    if manifest is None:
        facts = files.agg((F.count("*") > 0).alias("artwork")).select(
            "artwork", F.lit(False).alias("records"), F.lit(0).alias("matched_count"))
    else:
        facts = exact_name_match(manifest, files).agg(
            F.coalesce(F.bool_or(F.col("state") != "missing"), F.lit(False)).alias("artwork"),
            F.coalesce(F.bool_or(F.col("state") != "extra"), F.lit(False)).alias("records"),
            F.count_if(F.col("state") == "matched").alias("matched_count"))
    given = F.lit(manifest is not None)
    artwork, records, matched = F.col("artwork"), F.col("records"), F.col("matched_count")
    batch = given & artwork & records & (matched > 0)
    manual = ~given & artwork & minimum
    message = (
        F.when(given & ~records,
               "The manifest is uploaded, but no valid manifest records were loaded.")
        .when(given & ~artwork,
              "Upload matching label artwork files to run the manifest batch.")
        .when(given & (matched <= 0),
              "No uploaded label artwork filenames match the manifest file_name values.")
        .when(given, "Ready to run manifest-driven batch verification.")
        .when(~artwork, "Upload label artwork to enable manual CAV verification.")
        .when(~minimum,
              "Complete the required CAV fields before running manual artwork verification.")
        .otherwise("Ready to run manual CAV artwork verification."))
    return facts.select(
        (batch | manual).alias("is_ready"),
        F.when(batch, "Manifest + Artwork Batch").when(manual, "Manual CAV + Artwork Review")
        .otherwise("Not Ready").alias("mode"),
        message.alias("message"))
