"""Table schemas and the option records that tune the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from attestra.constants import SPIRITS

TEXT_COLUMNS = (
    "brand_name", "class_type", "beverage_type", "net_contents", "producer_bottler",
    "importer", "country_of_origin", "cola_id", "notes",
)

MANIFEST = T.StructType(
    [T.StructField("row_id", T.LongType()), T.StructField("file_name", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("brand_name", "class_type", "beverage_type")]
    + [T.StructField(c, T.DoubleType()) for c in ("alcohol_content", "proof")]
    + [T.StructField(c, T.StringType()) for c in ("net_contents", "producer_bottler")]
    + [T.StructField("imported", T.BooleanType())]
    + [T.StructField(c, T.StringType())
       for c in ("importer", "country_of_origin", "cola_id", "notes")]
)

LABEL_TEXT = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("ocr_engine", T.StringType()),
    T.StructField("ocr_seconds", T.DoubleType()),
    T.StructField("image_quality_notes", T.ArrayType(T.StringType())),
    T.StructField("created_on", T.TimestampType()),
])

RESULT = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("field_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("expected", T.StringType()),
    T.StructField("observed", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("requires_human_review", T.BooleanType()),
])


@dataclass(frozen=True)
class Application:
    """Expected values of one label, for the one-application paths."""

    brand_name: str = ""
    class_type: str = ""
    beverage_type: str = SPIRITS
    alcohol_content: float | None = None
    proof: float | None = None
    net_contents: str = ""
    producer_bottler: str = ""
    imported: bool = False
    importer: str = ""
    country_of_origin: str = ""
    government_warning: str = ""
    cola_id: str = ""
    notes: str = ""


@dataclass(frozen=True)
class RuleOptions:
    brand_threshold: float = 90.0
    class_threshold: float = 85.0
    net_threshold: float = 95.0
    abv_tolerance: float = 0.25
    proof_tolerance: float = 0.75
    near_warning_threshold: float = 92.0
    warning_window: int = 420
    context_window: int = 80


@dataclass(frozen=True)
class SlaOptions:
    sla_seconds: float = 5.0
    max_average_seconds: float = 5.0
    max_p95_seconds: float = 5.0
    max_breach_rate: float = 0.0
    min_files: int = 20
    max_files: int = 50

    def sla(self) -> float:
        return self.sla_seconds if self.sla_seconds > 0 else 5.0


@dataclass(frozen=True)
class QualityOptions:
    min_width: int = 800
    min_height: int = 800
    min_contrast: float = 20.0
    min_blur: float = 35.0
    max_glare: float = 0.35
    max_dark: float = 0.25
    max_skew: float = 8.0


@dataclass(frozen=True)
class RetentionOptions:
    no_persistence_mode: bool = True
    long_term_storage_disabled: bool = True
    upload_persistence_enabled: bool = False
    raw_text_logging_enabled: bool = False
    raw_ocr_export_enabled: bool = False
    extracted_data_export_enabled: bool = False
    redacted_evidence_export_enabled: bool = True
    file_path_export_enabled: bool = False
    strict: bool = False

    @property
    def can_export_values(self) -> bool:
        return not self.no_persistence_mode and self.extracted_data_export_enabled

    @property
    def can_export_raw_text(self) -> bool:
        return not self.no_persistence_mode and self.raw_ocr_export_enabled

    @property
    def can_export_paths(self) -> bool:
        return not self.no_persistence_mode and self.file_path_export_enabled

    @property
    def can_write_evidence(self) -> bool:
        return self.redacted_evidence_export_enabled
