"""The verification rules as one narrow projection over (application, label text) rows.

``verify_labels`` adds the values the rules share (folded text, extracted values, fuzzy
scores, warning signals) as flat columns, once each, and then builds the ordered result array.
No shuffle: the cost per row is one pass of each regular expression, one folding UDF call for
non-ASCII values and one fuzzy UDF call for values that plain containment does not settle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from attestra.constants import (
    ALCOHOL_FIELD, BRAND_FIELD, CLASS_FIELD, COUNTRY_FIELD, COUNTRY_PATTERN, IMPORTER_FIELD,
    IMPORTER_PATTERN, NET_FIELD, PRODUCER_FIELD, PRODUCER_PATTERN, PROOF_FIELD, SPIRITS,
    WARNING_FIELD, WARNING_TEXT_NORMALIZED,
)
from attestra.functions import extract, fuzzy
from attestra.functions import text as tx
from attestra.operators import warning as wn
from attestra.operators.outcomes import rule_result
from attestra.operators.results import (
    rules_unavailable_result, unreadable_text_result, verification_exception_result, verification_unavailable_result,
)
from attestra.schema import RESULT, RuleOptions

IMPORT_RULES = ("importer_present", "country_of_origin_present")


def required_field_map() -> Column:
    """Expected values by field name; the importer only for imported products."""
    names = ((BRAND_FIELD, "brand_name"), (CLASS_FIELD, "class_type"),
             (ALCOHOL_FIELD, "alcohol_content"), (PROOF_FIELD, "proof"),
             (NET_FIELD, "net_contents"), (PRODUCER_FIELD, "producer_bottler"),
             (COUNTRY_FIELD, "country_of_origin"), (WARNING_FIELD, "government_warning"))
    common = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in names]),
                               F.array(*[F.col(c).cast("string") for _, c in names]))
    importer = F.map_from_arrays(F.array(F.lit(IMPORTER_FIELD)), F.array("importer"))
    return F.when(F.col("imported"), F.map_concat(common, importer)).otherwise(common)


def _suffixed(value: Column, suffix: str) -> Column:
    return F.concat(tx.format_g(value), F.lit(suffix))


def with_signals(labels: DataFrame, options: RuleOptions = RuleOptions()) -> DataFrame:
    """Add one ``_``-prefixed column per value that several rules read."""
    c = F.col
    text = tx.blank(c("raw_text"))

    def seen(pattern):
        return F.regexp_extract(text, extract.ANY_CASE + pattern, 0)

    folded = labels.withColumns({
        "_text": tx.fold_ascii(text, pinned=True),
        "_brand": tx.fold_ascii(c("brand_name"), pinned=True),
        "_class": tx.fold_ascii(c("class_type"), pinned=True),
        "_net": tx.fold_ascii(c("net_contents"), pinned=True),
    })
    normal = folded.withColumns({
        "_readable": tx.has_text(text),
        "_spirits": tx.blank(c("beverage_type")) == SPIRITS,
        "_match": tx.match_folded(c("_text")),
        "_plain": tx.normalize_folded(c("_text")),
        "_brand_match": tx.match_folded(c("_brand")),
        "_class_match": tx.match_folded(c("_class")),
        "_abv_wanted": tx.number_or_null(c("alcohol_content")),
        "_abv": extract.rule_abv(text),
        "_proof": extract.rule_proof(text),
        "_net_seen": extract.rule_net_contents(text),
        "_net_wanted": tx.net_contents_folded(c("_net")),
        "_producer_seen": seen(PRODUCER_PATTERN),
        "_importer_seen": F.when(c("imported"), seen(IMPORTER_PATTERN)),
        "_country_seen": F.when(c("imported"), seen(COUNTRY_PATTERN)),
        **wn.prefix_signals(options),
    })
    match = c("_match")
    flagged = normal.withColumns({
        "_brand_in": F.contains(match, c("_brand_match")),
        "_class_in": F.contains(match, c("_class_match")),
        "_exact": wn.has_standard_text(match),
        "_abv_text": _suffixed(c("_abv"), "% ABV"),
        "_abv_wanted_text": _suffixed(c("_abv_wanted"), "% ABV"),
        "_proof_text": _suffixed(c("_proof"), " Proof"),
        "_proof_wanted_text": _suffixed(tx.proof_from_abv(c("_abv")), " Proof"),
        "_abv_ok": tx.values_close(c("_abv_wanted"), c("_abv"), options.abv_tolerance),
        "_proof_ok": tx.values_close(
            tx.proof_from_abv(c("_abv")), c("_proof"), options.proof_tolerance),
        "_brand_context": tx.context_of(
            c("_plain"), tx.normalize_folded(c("_brand")), options.context_window),
        "_class_context": tx.context_of(
            c("_plain"), tx.normalize_folded(c("_class")), options.context_window),
    })
    # The three needles share one gated text argument, so Arrow carries the text once.
    open_text = F.when(
        c("_readable") & ~(c("_brand_in") & c("_class_in") & c("_exact")), match)
    scored = flagged.withColumns({
        "_brand_score": fuzzy.partial_ratio_gated(
            F.when(~c("_brand_in"), c("_brand_match")), open_text),
        "_class_score": fuzzy.partial_ratio_gated(
            F.when(~c("_class_in"), c("_class_match")), open_text),
        "_similarity": fuzzy.partial_ratio_gated(
            F.when(~c("_exact"), F.lit(WARNING_TEXT_NORMALIZED)), open_text),
        "_net_score": fuzzy.ratio(
            F.when(c("_net_seen") != "", c("_net_wanted")), c("_net_seen")),
    })
    settled = scored.withColumns({
        "_brand_score": F.when(c("_brand_in"), 100.0).otherwise(F.coalesce(c("_brand_score"), F.lit(0.0))),
        "_class_score": F.when(c("_class_in"), 100.0).otherwise(F.coalesce(c("_class_score"), F.lit(0.0))),
        "_similarity": F.when(c("_exact"), 100.0).otherwise(
            F.coalesce(c("_similarity"), F.lit(0.0))),
    })
    return wn.with_warning(settled, options)


def rule_columns(options: RuleOptions = RuleOptions()) -> dict[str, Column]:
    """Result structs by rule id, in report order, over a ``with_signals`` frame."""
    c = F.col
    abv, proof = c("_abv").isNotNull(), c("_proof").isNotNull()
    net_given, net_seen = c("_net_wanted") != "", c("_net_seen") != ""
    nothing = F.lit("")

    def fuzzy_code(needle, score, threshold):
        return F.when(c(needle) == "", 1).when(c(score) >= threshold, 2).otherwise(3)

    def found(rule_id, column, expected=None):
        return rule_result(rule_id, F.when(c(column) != "", 1).otherwise(2), expected=expected,
                           observed=c(column), evidence=c(column))

    country = tx.blank(c("country_of_origin"))
    return {
        "brand_name_match": rule_result(
            "brand_name_match",
            fuzzy_code("_brand_match", "_brand_score", options.brand_threshold),
            expected=c("brand_name"), confidence=c("_brand_score"),
            evidence=F.when(c("_brand_match") == "", "").otherwise(c("_brand_context"))),
        "class_type_match": rule_result(
            "class_type_match",
            fuzzy_code("_class_match", "_class_score", options.class_threshold),
            expected=c("class_type"), confidence=c("_class_score"),
            evidence=F.when(c("_class_match") == "", "").otherwise(c("_class_context"))),
        "alcohol_content_present": rule_result(
            "alcohol_content_present", F.when(abv, 1).otherwise(2), observed=c("_abv_text"),
            evidence=F.coalesce(c("_abv_text"), nothing)),
        "alcohol_content_match": rule_result(
            "alcohol_content_match",
            F.when(c("_abv_wanted").isNull(), 1).when(~abv, 2).when(c("_abv_ok"), 3)
            .otherwise(4),
            expected=c("_abv_wanted_text"), observed=c("_abv_text"),
            evidence=F.when(c("_abv_wanted").isNotNull() & abv, c("_abv_text")).otherwise("")),
        "proof_present": rule_result(
            "proof_present", F.when(~c("_spirits"), 1).when(proof, 2).otherwise(3),
            observed=c("_proof_text"),
            evidence=F.when(c("_spirits") & proof, c("_proof_text")).otherwise("")),
        "proof_consistency": rule_result(
            "proof_consistency",
            F.when(~c("_spirits"), 1).when(~(abv & proof), 2).when(c("_abv") == 0, 3)
            .when(c("_proof_ok"), 4).otherwise(5),
            expected=c("_proof_wanted_text"), observed=c("_proof_text"),
            evidence=F.when(
                c("_spirits") & proof & (c("_abv") != 0),
                F.concat(c("_abv_text"), F.lit(" / "), c("_proof_text"))).otherwise("")),
        "net_contents_present": found("net_contents_present", "_net_seen"),
        "net_contents_match": rule_result(
            "net_contents_match",
            F.when(~net_given, 1).when(~net_seen, 2)
            .when(c("_net_score") >= options.net_threshold, 3).otherwise(4),
            expected=c("_net_wanted"), observed=c("_net_seen"), confidence=c("_net_score"),
            evidence=F.when(net_given, c("_net_seen")).otherwise("")),
        "producer_bottler_present": found("producer_bottler_present", "_producer_seen"),
        **wn.warning_columns(),
        "importer_present": found("importer_present", "_importer_seen"),
        "country_of_origin_present": found(
            "country_of_origin_present", "_country_seen",
            F.when(country != "", country).otherwise("Country of origin for imported product")),
    }


#: Ways into the verification; each has its own answer to input it cannot work with.
FROM_FILE, FROM_TEXT, FROM_RULES = "file", "text", "rules"


def input_error(entry: str, given: Column | None = None) -> Column:
    """What is wrong with a row's input as ``(argument, message)``; null where nothing is.

    ``given`` tells whether the row has an application. The error of one row leaves the others and
    their rules alone.
    """
    application = F.lit(True) if given is None else F.coalesce(given, F.lit(False))
    missing = [("application", ~application)]
    if entry != FROM_FILE:
        missing.append(("text", tx.blank(F.col("raw_text")) == ""))
    if entry == FROM_TEXT:
        missing.append(("file_name", tx.blank(F.col("file_name")) == ""))
    return F.coalesce(*[F.when(wrong, F.struct(
        F.lit(name).alias("argument"), F.lit(f'ValueError: Argument "{name}" cannot be empty!').alias("message")))
        for name, wrong in missing])


def fallback_result(entry: str, error: Column) -> Column:
    """The one result of a row with an input error."""
    if entry == FROM_FILE:
        return verification_exception_result(error["message"])
    return verification_unavailable_result() if entry == FROM_TEXT else rules_unavailable_result()


def every_result(options: RuleOptions = RuleOptions()) -> Column:
    """Thirteen results, two more for imports, over a ``with_signals`` frame."""
    rules = rule_columns(options)
    common = [v for k, v in rules.items() if k not in IMPORT_RULES]
    extra = [rules[k] for k in IMPORT_RULES]
    imported = F.coalesce(F.col("imported"), F.lit(False))
    more = F.when(imported, F.array(*extra)).otherwise(F.array().cast(ArrayType(RESULT)))
    return F.concat(F.array(*common), more)


def results_array(every: Column, entry: str = FROM_FILE, error: Column | None = None) -> Column:
    """``every`` result, or one for unreadable text or an input error.

    The rule set by itself does not ask whether a text is readable.
    """
    done = every if entry == FROM_RULES else F.when(F.col("_readable"), every).otherwise(
        F.array(unreadable_text_result(F.col("image_quality_notes"))))
    if error is None:
        return done
    return F.when(error.isNotNull(), F.array(fallback_result(entry, error))).otherwise(done)


def verify_labels(labels: DataFrame, options: RuleOptions = RuleOptions(), entry: str = FROM_FILE,
                  given: Column | None = None) -> DataFrame:
    """Add ``results`` to rows that hold an application and its label text.

    Expects the manifest columns plus ``raw_text`` and ``image_quality_notes``. ``given`` tells
    which rows have an application at all; a row without one, and a blank text where ``entry`` says
    that there must be one, has a single result that asks for review.
    """
    checked = with_signals(labels, options)
    error = None
    if given is not None or entry != FROM_FILE:
        checked = checked.withColumn("_error", input_error(entry, given))
        error = F.col("_error")
    done = checked.withColumn("results", results_array(every_result(options), entry, error))
    return done.select(*labels.columns, "results")


def verify_entries(labels: DataFrame, entries: tuple[str, ...] = (FROM_FILE, FROM_TEXT, FROM_RULES),
                   options: RuleOptions = RuleOptions(), given: Column | None = None) -> DataFrame:
    """As ``verify_labels`` for each way in: a row per label and ``entry``. The rules run once a label."""
    checked = with_signals(labels, options).withColumns(
        {"_every": every_result(options)} | {f"_error_{entry}": input_error(entry, given) for entry in entries})
    answers = F.array(*[F.struct(
        F.lit(entry).alias("entry"),
        results_array(F.col("_every"), entry, F.col(f"_error_{entry}")).alias("results")) for entry in entries])
    return checked.select(*labels.columns, F.explode(answers).alias("_answer")).select(*labels.columns, "_answer.*")


def rule_table(labels: DataFrame, rule_id: str,
               options: RuleOptions = RuleOptions()) -> DataFrame:
    """One rule alone over readable rows; signals it does not read leave the plan."""
    signals = with_signals(labels, options).where(F.col("_readable"))
    if rule_id in IMPORT_RULES:
        signals = signals.where(F.col("imported"))
    picked = signals.select("file_name", rule_columns(options)[rule_id].alias("r"))
    return picked.select("file_name", "r.*")
