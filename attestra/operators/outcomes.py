"""What each rule can report: fixed outcomes, numbered from 1 in the order listed here.

A rule is an integer outcome column plus the few values that depend on the row. Everything
else is looked up in literal arrays, which Catalyst folds to constants; the generated code
stays small and every regular expression appears in the plan once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.constants import (
    ALCOHOL_FIELD, BRAND_FIELD, CLASS_FIELD, COUNTRY_FIELD, FAIL, HIGH, IMPORTER_FIELD, INFO,
    LOW, MEDIUM, NET_FIELD, NOT_APPLICABLE, PASS, PRODUCER_FIELD, PROOF_FIELD, REVIEW, WARNING,
    WARNING_FIELD, WARNING_PREFIX, WARNING_TEXT,
)


@dataclass(frozen=True)
class Outcome:
    """Fixed part of a result; None marks a value the row supplies."""

    status: str
    severity: str
    confidence: float | None
    review: bool
    message: str
    expected: str | None = None
    observed: str | None = None


_NOT_APPLICABLE = "Not applicable to selected beverage type"
VISUAL_LOOK = (
    "Confirm visually that the government warning is present, bold where required, readable, "
    "prominent, sufficiently contrasted, and not hidden or obscured."
)
_VISUAL_INSPECT = (
    "Government warning visual formatting cannot be evaluated because the warning text was not "
    "detected. Reviewer must inspect the label artwork manually."
)
_VISUAL_EXPECTED = (
    "Reviewer confirmation of warning boldness, readability, contrast, prominence, and visibility"
)
_VISUAL_SEEN = "Warning text detected; visual formatting requires human confirmation"


def _presence(expected, confidences, passed, failed, observed=None):
    return (Outcome(PASS, INFO, confidences[0], False, passed, expected, observed),
            Outcome(FAIL, HIGH, confidences[1], True, failed, expected, "Not found"))


# Rule id -> (field name, outcomes). Fixed values throughout.
RULES = {
    "brand_name_match": (BRAND_FIELD, (
        Outcome(REVIEW, MEDIUM, 0.0, True, "A brand name was not provided for comparison.",
                "Brand name from application", "No expected brand name provided"),
        Outcome(PASS, INFO, None, False, "Brand name appears to match the label text.",
                None, "Found in label text"),
        Outcome(REVIEW, MEDIUM, None, True,
                "Brand name does not clearly match and requires reviewer judgment.",
                None, "Not clearly found"))),
    "class_type_match": (CLASS_FIELD, (
        Outcome(REVIEW, MEDIUM, 0.0, True,
                "A class/type designation was not provided for comparison.",
                "Class/type designation from application", "No expected class/type provided"),
        Outcome(PASS, INFO, None, False,
                "Class/type designation appears to match the label text.",
                None, "Found in label text"),
        Outcome(REVIEW, MEDIUM, None, True,
                "Class/type designation does not clearly match and requires review.",
                None, "Not clearly found"))),
    "alcohol_content_present": (ALCOHOL_FIELD, _presence(
        "Alcohol content statement", (95.0, 90.0),
        "Alcohol content was detected in the label text.",
        "Alcohol content was not detected in the label text.")),
    "alcohol_content_match": (ALCOHOL_FIELD, (
        Outcome(REVIEW, MEDIUM, 0.0, True,
                "Expected alcohol content was not provided for comparison.",
                "Expected ABV from application", "No expected ABV provided"),
        Outcome(FAIL, HIGH, 90.0, True,
                "Expected alcohol content could not be found on the label.", None, "Not found"),
        Outcome(PASS, INFO, 98.0, False,
                "Expected alcohol content matches detected label alcohol content."),
        Outcome(FAIL, HIGH, 95.0, True,
                "Expected alcohol content does not match detected label alcohol content."))),
    "proof_present": (PROOF_FIELD, (
        Outcome(NOT_APPLICABLE, INFO, 100.0, False,
                "Proof check is not applicable to the selected beverage type.",
                "Proof statement for distilled spirits", _NOT_APPLICABLE),
        Outcome(PASS, INFO, 95.0, False, "Proof statement was detected.",
                "Proof statement for distilled spirits"),
        Outcome(WARNING, LOW, 75.0, False,
                "Proof statement was not detected; reviewer should confirm if required.",
                "Proof statement for distilled spirits", "Not found"))),
    "proof_consistency": (PROOF_FIELD, (
        Outcome(NOT_APPLICABLE, INFO, 100.0, False,
                "Proof consistency check is not applicable to the selected beverage type.",
                "Proof equals twice ABV", _NOT_APPLICABLE),
        Outcome(WARNING, LOW, 70.0, False,
                "ABV/proof consistency could not be fully evaluated from label text.",
                "Proof equals twice ABV", "ABV or proof missing"),
        # A detected ABV of zero has no expected proof: reported as not executable.
        Outcome(REVIEW, HIGH, 0.0, True,
                "Proof consistency verification could not be completed.",
                "Proof consistency", "Rule execution failed"),
        Outcome(PASS, INFO, 98.0, False, "Detected proof is consistent with detected ABV."),
        Outcome(FAIL, HIGH, 95.0, True,
                "Detected proof is not consistent with detected ABV."))),
    "net_contents_present": (NET_FIELD, _presence(
        "Net contents statement", (95.0, 90.0), "Net contents were detected in the label text.",
        "Net contents were not detected in the label text.")),
    "net_contents_match": (NET_FIELD, (
        Outcome(REVIEW, MEDIUM, 0.0, True,
                "Expected net contents were not provided for comparison.",
                "Expected net contents from application", "No expected net contents provided"),
        Outcome(FAIL, HIGH, 90.0, True,
                "Expected net contents could not be found on the label.", None, "Not found"),
        Outcome(PASS, INFO, None, False,
                "Expected net contents match detected label net contents."),
        Outcome(FAIL, HIGH, None, True,
                "Expected net contents do not match detected label net contents."))),
    "producer_bottler_present": (PRODUCER_FIELD, _presence(
        "Producer, bottler, brewer, or distiller statement", (95.0, 85.0),
        "Producer/bottler language was detected.",
        "Producer/bottler language was not detected.")),
    "government_warning_present": (WARNING_FIELD, _presence(
        "Government warning statement", (95.0, 90.0),
        "Government warning language was detected.",
        "Government warning language was not detected.", "Found")),
    "government_warning_exact": (WARNING_FIELD, (
        Outcome(PASS, INFO, 100.0, False,
                "The standard government warning text was detected exactly after strict "
                "normalization.", WARNING_TEXT, "Exact standard warning text detected"),
        Outcome(FAIL, HIGH, None, True,
                "Government warning text is similar to the required standard warning, but the "
                "exact-text rule fails because the wording requirement is strict.",
                WARNING_TEXT, "Near match detected but exact text requirement failed"),
        Outcome(FAIL, HIGH, None, True,
                "The exact standard government warning text was not detected.",
                WARNING_TEXT, "Standard warning text not detected"))),
    "government_warning_prefix_caps": (WARNING_FIELD, (
        Outcome(PASS, INFO, 98.0, False,
                "The required all-caps GOVERNMENT WARNING: prefix was detected.",
                WARNING_PREFIX, WARNING_PREFIX),
        Outcome(FAIL, HIGH, 90.0, True,
                "The required all-caps GOVERNMENT WARNING: prefix was not detected.",
                WARNING_PREFIX, "Not found as all caps"))),
    "government_warning_visual_format": (WARNING_FIELD, (
        Outcome(REVIEW, MEDIUM, 0.0, True, VISUAL_LOOK, _VISUAL_EXPECTED, _VISUAL_SEEN),
        Outcome(REVIEW, HIGH, 0.0, True, VISUAL_LOOK, _VISUAL_EXPECTED, _VISUAL_SEEN),
        Outcome(REVIEW, HIGH, 0.0, True, _VISUAL_INSPECT, _VISUAL_EXPECTED,
                "Warning text not detected; visual formatting cannot be evaluated"))),
    "importer_present": (IMPORTER_FIELD, _presence(
        "Importer statement for imported product", (95.0, 85.0),
        "Importer language was detected for the imported product.",
        "Importer language was not detected for the imported product.")),
    "country_of_origin_present": (COUNTRY_FIELD, _presence(
        None, (95.0, 85.0), "Country-of-origin language was detected for the imported product.",
        "Country-of-origin language was not detected for the imported product.")),
}


def _lookup(values: list, code: Column, dynamic: Column | None) -> Column:
    if all(v is None for v in values):
        return dynamic
    if None not in values and len(set(values)) == 1:
        return F.lit(values[0])
    fixed = F.get(F.array(*[F.lit(v) for v in values]), code - 1)
    return fixed if None not in values else F.coalesce(fixed, dynamic)


def rule_result(rule_id: str, code: Column, *, expected: Column | None = None,
                observed: Column | None = None, confidence: Column | None = None,
                evidence: Column | None = None) -> Column:
    """Result struct of a rule from its outcome number and row-dependent values."""
    field_name, outcomes = RULES[rule_id]

    def pick(name, dynamic=None):
        return _lookup([getattr(o, name) for o in outcomes], code, dynamic)

    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(field_name).alias("field_name"),
        pick("status").alias("status"),
        pick("severity").alias("severity"),
        pick("expected", expected).alias("expected"),
        pick("observed", observed).alias("observed"),
        pick("confidence", confidence).alias("confidence"),
        (F.lit("") if evidence is None else evidence).alias("evidence"),
        pick("message").alias("message"),
        pick("review").alias("requires_human_review"),
    )
