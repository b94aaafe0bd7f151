"""Rules, reports and comparisons over the label fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.constants import (
    ABV_PATTERN, COUNTRY_PATTERN, IMPORTER_PATTERN, NET_PATTERN, PRODUCER_PATTERN,
    PROOF_PATTERN, WARNING_TEXT, WARNING_TEXT_NORMALIZED,
)
from attestra.functions import extract
from attestra.functions import text as tx
from attestra.operators import reports as rp
from attestra.operators import rules, warning
from attestra.operators.outcomes import RULES
from attestra.plans import batch
from checks.fixture import FIXTURE, labels
from checks.registry import documents, query, table
from checks.text_queries import (
    EXTRACT_SELECT, _NET_PAIRS, context_sql, lcs_sql, lines_sql, masks_sql, match, normal,
    partial_ratio_sql, replaced, spaced,
)

CREATED = "2026-01-15 12:00:00"


def found(pattern, group=0):
    return f"regexp_extract(raw_text, '{pattern}', {group}, 'i')"


def number(pattern):
    return f"try_cast(nullif({found(pattern, 1)}, '') as double)"


# The label texts are ASCII. A near match is decided here by edit distance from the warning's
# prefix on: at most 21 edits in 274 characters bounds the similarity above 92 from below, and
# altered and absent warnings of the labels lie far on either side.
SIGNALS = f"""
with fx as ({FIXTURE}),
norm as (
  select *, {match('raw_text')} as m, {normal('raw_text')} as p, {match('brand_name')} as bm,
    {match('class_type')} as cm, {normal('brand_name')} as bp, {normal('class_type')} as cp,
    nullif(alcohol_content, 0) as abv_wanted, {number(ABV_PATTERN)} as abv,
    {number(PROOF_PATTERN)} as proof_seen,
    case when {found(NET_PATTERN)} = '' then '' else {spaced(replaced(
        "lower(" + found(NET_PATTERN, 1) + " || ' ' || " + found(NET_PATTERN, 2) + ")",
        _NET_PAIRS))} end as net_seen,
    {spaced(replaced(normal('net_contents'), _NET_PAIRS))} as net_wanted,
    {found(PRODUCER_PATTERN)} as producer_seen, {found(IMPORTER_PATTERN)} as importer_seen,
    {found(COUNTRY_PATTERN)} as country_seen,
    regexp_matches(raw_text, '\\bgovernment\\s+warning\\s*:', 'i') as prefix,
    regexp_matches(raw_text, '\\bGOVERNMENT\\s+WARNING\\s*:') as caps,
    trim(left(regexp_extract(raw_text, '\\bgovernment\\s+warning\\s*:.*', 0, 'is'), 420)) as context
  from fx),
flags as (
  select *, contains(m, '{WARNING_TEXT_NORMALIZED}') as exact,
    not contains(m, '{WARNING_TEXT_NORMALIZED}') and instr(m, 'government warning') > 0 and
      levenshtein(substr(m, instr(m, 'government warning'), 274), '{WARNING_TEXT_NORMALIZED}') <= 21
      as near,
    abv is not null as has_abv, proof_seen is not null as has_proof,
    beverage_type = 'Distilled Spirits' as spirits,
    format('{{:g}}', abv) || '% ABV' as abv_text, format('{{:g}}', abv_wanted) || '% ABV' as wanted_text,
    format('{{:g}}', proof_seen) || ' Proof' as proof_text,
    format('{{:g}}', nullif(abv, 0) * 2) || ' Proof' as proof_wanted_text,
    coalesce(abv_wanted <> 0 and abv <> 0 and abs(abv_wanted - abv) <= 0.25, false) as abv_ok,
    coalesce(abv <> 0 and proof_seen <> 0 and abs(2 * abv - proof_seen) <= 0.75, false) as proof_ok,
    case when net_seen = '' then null
         else 200.0 * {lcs_sql('net_wanted', masks_sql('net_wanted', 'net_seen'))} /
              (length(net_wanted) + length(net_seen)) end as net_score,
    contains(m, bm) as brand_in, contains(m, cm) as class_in
  from norm where raw_text <> ''),
fuzzy_brand as materialized ({partial_ratio_sql(
    "(select row_id, bm, m from flags where not brand_in)", 'row_id', 'bm', 'm')}),
fuzzy_class as materialized ({partial_ratio_sql(
    "(select row_id, cm, m from flags where not class_in)", 'row_id', 'cm', 'm')}),
sig as (
  select f.*, case when brand_in then 100.0 else b.score end as brand_score,
         case when class_in then 100.0 else k.score end as class_score,
         prefix or exact or near as present
  from flags f left join fuzzy_brand b using (row_id) left join fuzzy_class k using (row_id))
"""


def _q(text):
    return "'" + text.replace("'", "''") + "'"


def _outcome(rule_id, code, name, dynamic="null"):
    """SQL picking an outcome's fixed value, or the row's where it is not fixed."""
    cases = []
    for i, outcome in enumerate(RULES[rule_id][1], start=1):
        value = getattr(outcome, name)
        text = (dynamic if value is None else _q(value) if isinstance(value, str)
                else str(value).lower())
        cases.append(f"when {i} then {text}")
    return f"case {code} {' '.join(cases)} end"


def _rule(rule_id, code, expected="null", observed="null", confidence="null", evidence="''",
          where="true"):
    parts = ", ".join(f"{_outcome(rule_id, code, n, d)} as {a}" for n, a, d in (
        ("status", "status", "null"), ("severity", "severity", "null"),
        ("expected", "expected", expected), ("observed", "observed", observed),
        ("message", "message", "null"), ("review", "requires_human_review", "null")))
    return (f"select file_name, '{rule_id}' as rule_id, '{RULES[rule_id][0]}' as field_name, {parts}, "
            f"round(cast({_outcome(rule_id, code, 'confidence', confidence)} as double), 6) as confidence, "
            f"{evidence} as evidence from sig where {where}")


def _seen(rule_id, column, expected="null", where="true"):
    return _rule(rule_id, f"(case when {column} <> '' then 1 else 2 end)", expected, column,
                 evidence=column, where=where)


RULE_SQL = {
    "brand_name_match": _rule(
        "brand_name_match", "(case when bm = '' then 1 when brand_score >= 90 then 2 else 3 end)",
        "brand_name", confidence="brand_score",
        evidence=f"case when bm = '' then '' else {context_sql('p', 'bp')} end"),
    "class_type_match": _rule(
        "class_type_match", "(case when cm = '' then 1 when class_score >= 85 then 2 else 3 end)",
        "class_type", confidence="class_score",
        evidence=f"case when cm = '' then '' else {context_sql('p', 'cp')} end"),
    "alcohol_content_present": _rule(
        "alcohol_content_present", "(case when has_abv then 1 else 2 end)", observed="abv_text",
        evidence="coalesce(abv_text, '')"),
    "alcohol_content_match": _rule(
        "alcohol_content_match",
        "(case when abv_wanted is null then 1 when not has_abv then 2 when abv_ok then 3 else 4 end)",
        "wanted_text", "abv_text",
        evidence="case when abv_wanted is not null and has_abv then abv_text else '' end"),
    "proof_present": _rule(
        "proof_present", "(case when not spirits then 1 when has_proof then 2 else 3 end)",
        observed="proof_text", evidence="case when spirits and has_proof then proof_text else '' end"),
    "proof_consistency": _rule(
        "proof_consistency",
        "(case when not spirits then 1 when not (has_abv and has_proof) then 2 when abv = 0 then 3 "
        "when proof_ok then 4 else 5 end)", "proof_wanted_text", "proof_text",
        evidence="case when spirits and has_abv and has_proof and abv <> 0 "
                 "then abv_text || ' / ' || proof_text else '' end"),
    "net_contents_present": _seen("net_contents_present", "net_seen"),
    "net_contents_match": _rule(
        "net_contents_match",
        "(case when net_wanted = '' then 1 when net_seen = '' then 2 when net_score >= 95 then 3 "
        "else 4 end)", "net_wanted", "net_seen", "net_score",
        "case when net_wanted <> '' then net_seen else '' end"),
    "producer_bottler_present": _seen("producer_bottler_present", "producer_seen"),
    "government_warning_present": _rule(
        "government_warning_present", "(case when present then 1 else 2 end)", evidence="context"),
    "government_warning_exact": _rule(
        "government_warning_exact", "(case when exact then 1 when near then 2 else 3 end)",
        evidence="context"),
    "government_warning_prefix_caps": _rule(
        "government_warning_prefix_caps", "(case when caps then 1 else 2 end)",
        evidence="context"),
    "government_warning_visual_format": _rule(
        "government_warning_visual_format", "(case when present then 1 else 3 end)",
        evidence="context"),
    "importer_present": _seen("importer_present", "importer_seen", where="imported"),
    "country_of_origin_present": _seen(
        "country_of_origin_present", "country_seen",
        "case when country_of_origin <> '' then country_of_origin "
        "else 'Country of origin for imported product' end", "imported"),
}
UNREADABLE_SQL = """
select file_name, 'ocr_text_extraction' as rule_id, 'Extracted Label Text' as field_name,
  'Needs Review' as status, 'High' as severity,
  'Readable label text from uploaded artwork' as expected,
  'No readable OCR text was extracted' as observed,
  'The uploaded label could not be read reliably by OCR. The label should be reviewed manually or resubmitted with clearer artwork.' as message,
  true as requires_human_review, 0.0::double as confidence, quality_note as evidence
from fx where raw_text = ''"""
RULE_ORDER = {r: i for i, r in enumerate(RULES)}


def _ordered(rule_id):
    return (f"select *, {RULE_ORDER[rule_id]} as ordinal from ({RULE_SQL[rule_id]})")


ALL_RULES = " union all ".join([_ordered(r) for r in RULES] + [
    f"select *, 0 as ordinal from ({UNREADABLE_SQL})"])
# Scores of inexact warnings have no SQL counterpart (see warning_similarity_*), so both sides
# leave them out there.
DETAILS = SIGNALS + f", details as materialized ({ALL_RULES}) "


def _without_similarity(df):
    scored = (F.col("rule_id") == "government_warning_exact") & (F.col("status") != "Pass")
    return df.withColumn("confidence", F.when(~scored, F.round("confidence", 6)))


def _register_rule(rule_id):
    @query(f"rule_{rule_id}", SIGNALS + RULE_SQL[rule_id])
    def one(spark, sf):
        return _without_similarity(rules.rule_table(labels(spark, sf), rule_id))
    return one


for _rule_id in RULES:
    _register_rule(_rule_id)


def checked(spark, sf):
    """Verified labels with the report columns."""
    made = rules.verify_labels(labels(spark, sf).withColumn("ocr_engine", F.lit("scan")))
    return batch._finish(made, F.lit(CREATED).cast("timestamp"))


@query("rules_detail", DETAILS + "select * from details")
def rules_detail(spark, sf):
    return _without_similarity(rp.detail_rows(checked(spark, sf)))


@query("unreadable_labels", SIGNALS + UNREADABLE_SQL)
def unreadable_labels(spark, sf):
    rows = rules.verify_labels(labels(spark, sf).where(~tx.has_text(F.col("raw_text"))))
    return rp.detail_rows(rows).drop("ordinal")


# A third of the labels has lost its application, another third its text or its name.
_DAMAGED = f"""damaged as (select row_id, row_id % 3 <> 0 as given, imported,
    case when row_id % 6 = 1 then '' else file_name end as file_name,
    case when row_id % 6 = 2 then null else raw_text end as raw_text, quality_note from ({FIXTURE}) f)"""


@query("fallback_results", f"""with {_DAMAGED}, e as (select *, unnest(['file', 'text', 'rules']) as entry from damaged),
j as (select *, case when not given then 'application' when entry <> 'file' and coalesce(raw_text, '') = '' then 'text'
                     when entry = 'text' and file_name = '' then 'file_name' end as wrong from e)
select row_id, entry, case when wrong is null then case when entry = 'rules' or coalesce(raw_text, '') <> '' then
    case when imported then 15 else 13 end else 1 end else 1 end::int as results,
  case when wrong is null then case when coalesce(raw_text, '') <> '' then 'brand_name_match' else 'ocr_text_extraction' end
       when entry = 'file' then 'verification_exception' when entry = 'text' then 'verification_unavailable'
       else 'verification_rules_unavailable' end as rule_id,
  case when wrong is not null then case when entry = 'file' then 'ValueError: Argument "' || wrong || '" cannot be empty!' else '' end
       when coalesce(raw_text, '') = '' then quality_note end as evidence,
  case when wrong is null and coalesce(raw_text, '') <> '' then null when wrong is null then
       'The uploaded label could not be read reliably by OCR. The label should be reviewed manually or resubmitted with clearer artwork.'
       when entry = 'rules' then 'The rule engine could not complete verification.'
       else 'The label could not be verified and requires human review.' end as message
from j""")
def fallback_results(spark, sf):
    """What each way into the verification answers to a row without application, text or name."""
    row = F.col("row_id")
    damaged = labels(spark, sf).withColumns({
        "file_name": F.when(row % 6 == 1, "").otherwise(F.col("file_name")),
        "raw_text": F.when(row % 6 == 2, F.lit(None)).otherwise(F.col("raw_text"))})
    done = rules.verify_entries(damaged, given=row % 3 != 0)
    first, shown = F.element_at("results", 1), F.element_at("results", 1)["rule_id"] != "brand_name_match"
    return done.select(
        "row_id", "entry", F.size("results").alias("results"), first["rule_id"].alias("rule_id"),
        F.when(shown, first["evidence"]).alias("evidence"), F.when(shown, first["message"]).alias("message"))


@query("rule_extractors", SIGNALS + """
select file_name, abv, proof_seen as proof, net_seen as net_contents from sig""")
def rule_extractors(spark, sf):
    text = F.col("raw_text")
    return labels(spark, sf).where(tx.has_text(text)).select(
        "file_name", extract.rule_abv(text).alias("abv"),
        extract.rule_proof(text).alias("proof"),
        extract.rule_net_contents(text).alias("net_contents"))


@query("rule_extractors_documents", rf"""
select doc_id, try_cast(nullif(regexp_extract(text, '{ABV_PATTERN}', 1, 'i'), '') as double) as abv,
  try_cast(nullif(regexp_extract(text, '{PROOF_PATTERN}', 1, 'i'), '') as double) as proof,
  case when regexp_extract(text, '{NET_PATTERN}', 0, 'i') = '' then '' else {spaced(replaced(
    "lower(regexp_extract(text, '" + NET_PATTERN + "', 1, 'i') || ' ' || regexp_extract(text, '"
    + NET_PATTERN + "', 2, 'i'))", _NET_PAIRS))} end as net_contents,
  regexp_extract(text, '{PRODUCER_PATTERN}', 0, 'i') as producer
from documents""")
def rule_extractors_documents(spark, sf):
    text = F.col("text")
    return documents(spark, sf).select(
        "doc_id", extract.rule_abv(text).alias("abv"), extract.rule_proof(text).alias("proof"),
        extract.rule_net_contents(text).alias("net_contents"),
        F.regexp_extract(text, extract.ANY_CASE + PRODUCER_PATTERN, 0).alias("producer"))


_MESSAGES = """list_filter([
  case when not prefix then 'Government warning prefix was not detected.' end,
  case when prefix and not caps then 'Government warning prefix is present but is not all caps.' end,
  case when exact then 'Standard government warning text was detected exactly.'
       when near then 'Government warning text is similar to the standard warning but fails the exact-text requirement and requires reviewer confirmation.'
       else 'Standard government warning text was not detected.' end,
  'OCR text checks cannot verify boldness, readable size, contrast, prominence, or whether the warning is visually hidden; reviewer visual confirmation is required.'
 ], lambda v: v is not null)"""


@query("warning_validation", SIGNALS + f"""
select file_name, present as text_present, prefix as prefix_present, caps as prefix_all_caps,
  exact as exact_text_match, near as near_text_match, false as visual_format_verified,
  true as visual_format_review_required,
  case when quality_note <> '' or not present then 'High' else 'Medium' end as risk_level,
  case when present then 'Confirm visually that the government warning is present, bold where required, readable, prominent, sufficiently contrasted, and not hidden or obscured.'
       else 'Inspect the label artwork manually because warning text was not detected by OCR and visual formatting cannot be evaluated automatically.' end as reviewer_instruction,
  context as warning_context, array_to_string({_MESSAGES}, ' / ') as messages
from sig
union all
select file_name, false, false, false, false, false, false, true, 'High',
  'Government warning validation could not be completed; review manually.', '',
  'Government warning validation could not be completed.'
from fx where raw_text = ''""")
def warning_validation(spark, sf):
    done = warning.validate_warnings(labels(spark, sf), notes="image_quality_notes")
    flat = done.select("file_name", "warning.*").drop("normalized_similarity")
    return flat.withColumn("messages", F.array_join("messages", " / "))


@query("warning_results", SIGNALS + """
select file_name, rule_id, status, severity, observed, ordinal from (
  select file_name, unnest(['government_warning_present', 'government_warning_exact',
      'government_warning_prefix_caps', 'government_warning_visual_format']) as rule_id,
    unnest([case when present then 'Pass' else 'Fail' end, case when exact then 'Pass' else 'Fail' end,
      case when caps then 'Pass' else 'Fail' end, 'Needs Review']) as status,
    unnest([case when present then 'Info' else 'High' end, case when exact then 'Info' else 'High' end,
      case when caps then 'Info' else 'High' end,
      case when quality_note <> '' or not present then 'High' else 'Medium' end]) as severity,
    unnest([case when present then 'Found' else 'Not found' end,
      case when exact then 'Exact standard warning text detected'
           when near then 'Near match detected but exact text requirement failed'
           else 'Standard warning text not detected' end,
      case when caps then 'GOVERNMENT WARNING:' else 'Not found as all caps' end,
      case when present then 'Warning text detected; visual formatting requires human confirmation'
           else 'Warning text not detected; visual formatting cannot be evaluated' end]) as observed,
    unnest([0, 1, 2, 3]) as ordinal
  from sig)
union all select file_name, 'government_warning_validation_unavailable', 'Needs Review', 'High',
  'Government-warning validation unavailable', 0 from fx where raw_text = ''""")
def warning_results(spark, sf):
    done = warning.validate_warnings(labels(spark, sf), notes="image_quality_notes")
    rows = done.select("file_name", F.posexplode_outer("warning_results").alias("ordinal", "r"))
    return rows.select("file_name", "r.rule_id", "r.status", "r.severity", "r.observed", "ordinal")


@query("warning_documents", r"""
select doc_id, regexp_matches(text, '\bgovernment\s+warning\s*:', 'i') as prefix_present,
  regexp_matches(text, '\bGOVERNMENT\s+WARNING\s*:') as prefix_all_caps from documents""")
def warning_documents(spark, sf):
    return documents(spark, sf).select(
        "doc_id", warning.has_any_prefix(F.col("text")).alias("prefix_present"),
        tx.has_caps_prefix(F.col("text")).alias("prefix_all_caps"))


# A window search with a 274-letter needle is beyond SQL; unit tests check it by brute force.
@query("warning_similarity_documents")
def warning_similarity_documents(spark, sf):
    docs = documents(spark, sf).withColumn(
        "m", tx.match_folded(tx.fold_ascii(F.col("text"), pinned=True)))
    return docs.select(
        "doc_id", F.round(warning.warning_similarity(F.col("m")), 6).alias("similarity"))


@query("warning_similarity_labels")
def warning_similarity_labels(spark, sf):
    signals = rules.with_signals(labels(spark, sf))
    return signals.select("file_name", F.round("_similarity", 6).alias("similarity"))


@query("required_fields", f"""
with fx as ({FIXTURE})
select file_name, unnest(list_concat(['Brand Name', 'Class / Type', 'Alcohol Content', 'Proof',
    'Net Contents', 'Producer / Bottler', 'Country of Origin', 'Government Warning'],
    case when imported then ['Importer'] else [] end)) as field,
  unnest(list_concat([brand_name, class_type, alcohol_content::varchar, proof::varchar, net_contents,
    producer_bottler, country_of_origin, ''], case when imported then [importer] else [] end)) as value
from fx""")
def required_fields(spark, sf):
    rows = labels(spark, sf).withColumn("government_warning", F.lit(""))
    return rows.select("file_name", F.explode(rules.required_field_map()).alias("field", "value"))


_PER_LABEL = """per_label as (
  select file_name, count(*) filter (status = 'Fail') as failures,
    count(*) filter (status = 'Warning') as warnings,
    count(*) filter (status = 'Needs Review' or requires_human_review) as reviews,
    count(*) filter (status = 'Pass') as passes, count(*) filter (status = 'Not Applicable') as na,
    count(*) filter (status = 'Needs Review') as review_status,
    case when count(*) filter (status = 'Fail') > 0 then 'Fail'
         when count(*) filter (status = 'Needs Review' or requires_human_review) > 0 then 'Needs Review'
         when count(*) filter (status = 'Warning') > 0 then 'Warning' else 'Pass' end as overall
  from details group by file_name)"""
_LABELS = DETAILS + ", " + _PER_LABEL


@query("report_summary", _LABELS + f"""
select f.file_name as "File Name", brand_name as "Brand Name", beverage_type as "Beverage Type",
  case when raw_text = '' then 'Not Found' else 'Found' end as "Extracted Label Text",
  overall as "Overall Status", failures as "Failures", warnings as "Warnings", reviews as "Needs Review",
  round(ocr_seconds::decimal(20,8), 2)::double as "Processing Seconds", '{CREATED}' as "Created On"
from fx f join per_label using (file_name)""")
def report_summary(spark, sf):
    return rp.summary(checked(spark, sf))


@query("report_detail", DETAILS + """
select file_name as "File Name", field_name as "Field Name", rule_id as "Rule ID", status as "Status",
  severity as "Severity", expected as "Expected", observed as "Observed", evidence as "Evidence",
  message as "Message",
  round(confidence::decimal(20,8), 2)::double as "Confidence" from details""")
def report_detail(spark, sf):
    rows = rp.detail(checked(spark, sf))
    inexact = (F.col("Rule ID") == "government_warning_exact") & (F.col("Status") != "Pass")
    return rows.withColumn("Confidence", F.when(~inexact, F.col("Confidence")))


@query("report_totals", _LABELS + """
select count(*) as total_files, count(*) filter (failures > 0) as total_failures,
  count(*) filter (warnings > 0) as total_warnings, count(*) filter (reviews > 0) as total_reviews
from per_label""")
def report_totals(spark, sf):
    return rp.batch_totals(checked(spark, sf))


@query("report_status_counts", _LABELS + """
select file_name as "File Name", passes as "Pass", warnings as "Warning", failures as "Fail",
  review_status as "Needs Review", na as "Not Applicable", overall as "Overall Status" from per_label""")
def report_status_counts(spark, sf):
    return rp.status_counts(checked(spark, sf))


@query("report_status_lines", _LABELS + """
select file_name, overall || ': ' || failures || ' failures, ' || warnings || ' warnings, ' ||
  reviews || ' review items' as line from per_label""")
def report_status_lines(spark, sf):
    return checked(spark, sf).select("file_name", rp.status_line(F.col("results")).alias("line"))


_BADGE = """case status when 'Pass' then '✅ Match' when 'Fail' then '❌ Mismatch'
  when 'Warning' then '⚠️ Warning' when 'Needs Review' then '⚠️ Needs Review' else status end"""
_ACTION = """case status when 'Pass' then 'No action required.'
  when 'Fail' then 'Correct the application, request corrected artwork, or escalate for review.'
  when 'Warning' then 'Review the field and confirm whether the variation is acceptable.'
  when 'Needs Review' then 'Human review required before final determination.'
  else 'Review the field before final determination.' end"""
_COMPARED = DETAILS + f""",
lined as (select file_name, raw_text as t, {lines_sql('raw_text')} as l from fx),
ext as (select file_name, {EXTRACT_SELECT} from lined),
joined as (
  select d.*, coalesce(nullif(trim(case field_name when 'Brand Name' then e.brand_name
      when 'Class / Type' then e.class_type when 'Alcohol Content' then e.alcohol_content::varchar
      when 'Net Contents' then e.net_contents when 'Producer / Bottler' then e.producer_bottler
      when 'Country of Origin' then e.country_of_origin
      when 'Government Warning' then e.government_warning end), ''), observed) as seen
  from details d join ext e using (file_name))
"""


@query("comparison_table", _COMPARED + f"""
select file_name as "File Name", field_name as "Field", expected as "Application", seen as "Extracted",
  {_BADGE} as "Status", severity as "Severity",
  round(confidence::decimal(20,8), 1)::double as "Confidence", message as "Explanation",
  {_ACTION} as "Reviewer Action",
  'Field: ' || field_name || ' | Application value: ' || coalesce(nullif(trim(expected), ''), 'Not provided')
    || ' | Extracted value: ' || coalesce(nullif(trim(seen), ''), 'Not detected')
    || coalesce(' | Explanation: ' || nullif(trim(message), ''), '')
    || coalesce(' | Evidence: ' || nullif(trim(evidence), ''), '') as "Tooltip"
from joined""")
def comparison_table(spark, sf):
    rows = rp.comparison(checked(spark, sf))
    inexact = (F.col("Application") == WARNING_TEXT) & ~F.col("Status").contains("Match")
    return rows.withColumn("Confidence", F.when(~inexact, F.col("Confidence")))


@query("comparison_display", _COMPARED + f"""
select file_name as "File Name", field_name as "Field", expected as "Application", seen as "Extracted",
  {_BADGE} as "Status", severity as "Severity", message as "Explanation", {_ACTION} as "Reviewer Action"
from joined""")
def comparison_display(spark, sf):
    return rp.comparison(checked(spark, sf), with_tooltip=False).drop("Confidence")


@query("evidence_comparison", DETAILS + """
select file_name as "File Name", field_name as "Field", expected as "Application",
  observed as "Extracted", status as "Status", severity as "Severity", message as "Explanation",
  case when requires_human_review then 'Review manually and confirm against source records.'
       when status = 'Pass' then 'No reviewer action required.'
       when status = 'Fail' then 'Resolve mismatch or request corrected source data.'
       when status in ('Warning', 'Needs Review') then 'Review supporting evidence before clearing.'
       else 'Review the result if the status is unclear.' end as "Reviewer Action"
from details""")
def evidence_comparison(spark, sf):
    return rp.evidence_comparison(checked(spark, sf)).drop("Confidence")


@query("image_diagnostics", f"""
with fx as ({FIXTURE}), b as (
  select file_name, raw_text <> '' as readable, quality_note as note, round(ocr_seconds::decimal(20,8), 3)::double as secs,
    case when raw_text = '' then '⚠️ Needs Review' when quality_note <> '' then '⚠️ Warning'
         else '✅ Match' end as badge,
    case when raw_text = '' then 'Request clearer artwork or manually review the submitted label because OCR did not return readable text.'
      when quality_note = '' then 'No image-quality issues were reported by the OCR preprocessing pipeline.'
      when contains(lower(quality_note), 'contrast') then 'Review the label manually or request a better-lit image with stronger text contrast.'
      else 'Review the label manually or request a straighter image with less rotation or perspective distortion.' end as advice
  from fx)
select file_name as "File Name", 0 as ordinal, 'OCR Text Found' as "Diagnostic",
  case when readable then '✅ Match' else '⚠️ Needs Review' end as "Status",
  case when readable then 'Yes' else 'No' end as "Value", advice as "Reviewer Guidance" from b
union all select file_name, 1, 'OCR Engine', badge, 'scan',
  'Confirm OCR output before relying on automated checks.' from b
union all select file_name, 2, 'OCR Seconds', badge, secs::varchar,
  'Longer timing may indicate large files or preprocessing overhead.' from b
union all select file_name, 3, case when note = '' then 'Image Quality Notes' else 'Image Quality Note 1' end,
  case when note = '' then '✅ Match' else '⚠️ Warning' end,
  case when note = '' then 'No image-quality notes reported.' else note end, advice from b""")
def image_diagnostics(spark, sf):
    return rp.diagnostics(labels(spark, sf).withColumn("ocr_engine", F.lit("scan")))
