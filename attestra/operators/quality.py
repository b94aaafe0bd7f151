"""Image quality: pixel statistics, readability score, warnings, verdict and notes.

Warnings, recommendations and notes are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.constants import FAIL, HIGH, INFO, LOW, MEDIUM, PASS, REVIEW, WARNING
from attestra.schema import QualityOptions


def pixel_statistics(pixels: DataFrame) -> DataFrame:
    """Per image, from ``(image_id, x, y, gray)``: size, brightness, contrast, ratios, blur.

    Blur is the variance of the 4-neighbour Laplacian with mirrored borders. Windows run over
    single image rows and columns, so one large image spreads over many tasks.
    """
    gray = F.col("gray").cast("double")
    base = pixels.select("image_id", "x", "y", gray.alias("g"))
    row = Window.partitionBy("image_id", "y").orderBy("x")
    column = Window.partitionBy("image_id", "x").orderBy("y")

    def neighbours(window: Window) -> Column:
        before, after = F.lag("g").over(window), F.lead("g").over(window)
        # Mirrored border: the missing neighbour equals the one on the other side.
        return (F.coalesce(before, after, F.col("g")) + F.coalesce(after, before, F.col("g")))

    across = base.withColumn("h", neighbours(row))
    both = across.withColumn("v", neighbours(column))
    return both.groupBy("image_id").agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"),
        F.avg("g").alias("brightness"), F.stddev_pop("g").alias("contrast"),
        F.var_pop(F.col("h") + F.col("v") - 4 * F.col("g")).alias("blur_score"),
        F.avg((F.col("g") >= 245).cast("int")).alias("glare_ratio"),
        F.avg((F.col("g") <= 35).cast("int")).alias("dark_ratio"))


def readability(options: QualityOptions = QualityOptions()) -> Column:
    c = F.col

    def share(value, limit, top):
        return F.least(F.lit(top), value / limit * top)

    def clamp(value):
        return F.least(F.lit(100.0), F.greatest(F.lit(0.0), value))

    score = (
        clamp(c("contrast") / options.min_contrast * 100.0) * 0.40
        + clamp(c("blur_score") / options.min_blur * 100.0) * 0.45 + 15.0
        - share(c("glare_ratio"), options.max_glare, 25.0)
        - share(c("dark_ratio"), options.max_dark, 35.0)
        - share(F.abs(c("skew_angle")), options.max_skew, 25.0))
    return clamp(score)


def _findings(o: QualityOptions):
    c = F.col
    return (
        ((c("width") < o.min_width) | (c("height") < o.min_height),
         "Image resolution is below the preferred OCR size.",
         "Request a higher-resolution label image."),
        (c("brightness") < 60.0, "Image appears underexposed or too dark.",
         "Request a brighter image or improve lighting."),
        ((c("brightness") > 245.0) & (c("contrast") < o.min_contrast),
         "Image appears overexposed or washed out.", "Request a retake without overexposure."),
        (c("contrast") < o.min_contrast, "Image contrast may be too low for reliable OCR.",
         "Increase contrast or request clearer artwork."),
        (c("blur_score") < o.min_blur, "Image may be blurry.",
         "Request a sharper image or direct artwork export."),
        ((c("glare_ratio") > o.max_glare) & (c("contrast") < 45.0),
         "Possible glare or washed-out image areas detected.",
         "Request an image without glare or reflections."),
        (c("dark_ratio") > o.max_dark, "Large dark areas may reduce OCR reliability.",
         "Request better lighting or a direct digital label."),
        (F.abs(c("skew_angle")) > o.max_skew, "Image appears skewed or rotated.",
         "Deskew image or request a straight-on label image."),
        (c("readability_score") < 50.0, "Overall readability is low.",
         "Manual review or resubmission is recommended."),
    )


def quality_verdict(metrics: DataFrame,
                    options: QualityOptions = QualityOptions()) -> DataFrame:
    """Add score, status, severity, warnings and recommendations to a metrics table."""
    scored = metrics.withColumn("readability_score", readability(options))
    score = F.col("readability_score")
    found = _findings(options)
    return scored.withColumns({
        "status": F.when(score >= 75.0, PASS).when(score >= 55.0, WARNING)
        .when(score >= 35.0, REVIEW).otherwise(FAIL),
        "severity": F.when(score >= 75.0, INFO).when(score >= 55.0, LOW)
        .when(score >= 35.0, MEDIUM).otherwise(HIGH),
        "warnings": F.array_compact(F.array(*[F.when(x, w) for x, w, _ in found])),
        "recommendations": F.array_compact(F.array(*[F.when(x, r) for x, _, r in found])),
    })


def preprocessing_profile() -> Column:
    c = F.col
    return (
        F.when(c("glare_ratio") >= 0.18, "glare_review")
        .when((c("dark_ratio") >= 0.30) | (c("brightness") < 70), "dark_image")
        .when(c("brightness") > 230, "overexposed").when(c("contrast") < 28, "low_contrast")
        .when(c("blur_score") < 80, "blur_review").otherwise("standard"))


def preprocessing_notes(options: QualityOptions = QualityOptions()) -> Column:
    """Notes of the preprocessing step; its thresholds differ from the verdict's."""
    c = F.col
    metrics = F.format_string(
        "Image metrics: %dx%d; brightness %.1f; contrast %.1f; blur %.1f; glare %.3f; "
        "dark %.3f; skew %.1f.", c("width"), c("height"), c("brightness"), c("contrast"),
        c("blur_score"), c("glare_ratio"), c("dark_ratio"), c("skew_angle"))
    issues = F.array_compact(F.array(
        F.when((c("width") < options.min_width) | (c("height") < options.min_height),
               "Image is smaller than preferred OCR dimensions."),
        F.when(c("brightness") < 60, "Image may be too dark for reliable OCR."),
        F.when(c("brightness") > 235, "Image may be overexposed for reliable OCR."),
        F.when(c("contrast") < 25, "Image may have low contrast."),
        F.when(c("blur_score") < 80,
               "Image may be blurry; OCR results require careful review."),
        F.when(c("glare_ratio") >= 0.18,
               "Image may contain glare or excessive bright regions; this prototype flags "
               "glare risk but does not perform true glare removal."),
        F.when(c("dark_ratio") >= 0.30,
               "Image contains a large dark region that may reduce OCR reliability."),
        F.when(F.abs(c("skew_angle")) >= 1.0, F.format_string(
            "Image may be skewed by approximately %.1f degrees.", c("skew_angle")))))
    clean = F.array(F.lit("No obvious image quality issues detected."))
    return F.concat(F.array(metrics), F.when(F.size(issues) > 0, issues).otherwise(clean))


def verdict_notes() -> Column:
    """Notes that carry a quality verdict into the label-text table."""
    c = F.col
    lead = F.array(
        F.concat(F.lit("Visual quality status: "), c("status"), F.lit(".")),
        F.format_string("Readability score: %.1f/100.", c("readability_score")),
        F.format_string(
            "Brightness: %.1f; contrast: %.1f; blur score: %.1f; glare ratio: %.3f; "
            "skew angle: %.1f.", c("brightness"), c("contrast"), c("blur_score"),
            c("glare_ratio"), c("skew_angle")))
    return F.concat(
        lead, F.transform("warnings", lambda w: F.concat(F.lit("Visual warning: "), w)),
        F.transform("recommendations",
                    lambda r: F.concat(F.lit("Visual recommendation: "), r)))
