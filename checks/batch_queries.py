"""Manifests, name matching, batches, timings, quality, redaction, retention and evidence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from attestra.constants import REDACTED, TEXT_NOTICE
from attestra.operators import checklists, evidence, matching, performance, quality, redaction
from attestra.operators import reports as rp
from attestra.plans import batch
from attestra.schema import Application
from attestra.sinks import markdown
from attestra.sinks.writers import json_lines, write_outputs
from attestra.sources import artwork
from attestra.sources.label_text import label_text
from attestra.sources.manifest import canonical_columns, load_manifest, typed_manifest
from checks.fixture import FIXTURE, labels
from checks.label_queries import CREATED, DETAILS, checked
from checks.registry import SQL, query, scratch, table

# --- manifest -----------------------------------------------------------------------------

_RAW = """
select {key} as k, case when o_orderkey % 11 = 0 then ' F' || o_orderkey || '.PNG ' else 'f' || o_orderkey || '.png' end as "Label File",
  case when o_orderkey % 7 = 0 then 'N/A' else ' ' || o_orderpriority || ' ' end as "Brand",
  o_orderstatus as "Class/Type",
  case when o_orderkey % 5 = 0 then '' when o_orderkey % 5 = 1 then 'nan' else 'Wine' end as "beverage-type",
  case when o_orderkey % 6 = 0 then '45.0%' when o_orderkey % 6 = 1 then '1,234.5 %'
       when o_orderkey % 6 = 2 then 'n/a' when o_orderkey % 6 = 3 then 'strong'
       else cast(o_orderkey % 60 as string) end as "Alcohol Content (% ABV)",
  '750 mL' as "NET_CONTENTS", 'P' || o_custkey as "Producer/Bottler",
  case o_orderkey % 9 when 0 then 'TRUE' when 1 then ' yes ' when 2 then 'X' when 3 then '1'
       when 4 then 'Imported' when 5 then 'no' when 6 then 'NULL' when 7 then '1.0' else '' end as "Imported",
  cast(o_orderdate as string) as "Application Reference", 'L' || o_orderkey as "Lot No"
from orders"""


def _raw_manifest(spark, sf):
    sql = _RAW.format(key="o_orderkey").replace('"', "`")
    return spark.sql(sql.replace("from orders", "from {orders}"),
                     orders=table(spark, sf, "orders")).withColumnRenamed("k", "row_id")


_NA = "('', 'N/A', 'nan', 'n/a', 'NULL')"


@query("manifest_typed", f"""
with r as ({_RAW.format(key='o_orderkey')}),
c as (select k, case when "Brand" in {_NA} then '' else trim("Brand") end as brand,
        case when "beverage-type" in {_NA} then '' else trim("beverage-type") end as bev,
        case when "Alcohol Content (% ABV)" in {_NA} then null else
          try_cast(replace(replace(trim("Alcohol Content (% ABV)"), '%', ''), ',', '') as double) end as abv,
        * from r)
select k as row_id, trim("Label File") as file_name, brand as brand_name, "Class/Type" as class_type,
  case when bev = '' then 'Distilled Spirits' else bev end as beverage_type, abv as alcohol_content,
  null::double as proof, "NET_CONTENTS" as net_contents, "Producer/Bottler" as producer_bottler,
  case when "Imported" in {_NA} then false
       else lower(trim("Imported")) in ('1', 'true', 'yes', 'y', 'imported', 'x') end as imported,
  '' as importer, '' as country_of_origin, substr("Application Reference", 1, 10) as cola_id, '' as notes
from c""")
def manifest_typed(spark, sf):
    typed = typed_manifest(canonical_columns(_raw_manifest(spark, sf)))
    return typed.withColumn("cola_id", F.substring("cola_id", 1, 10))


@query("manifest_files", f"""
with t as ({SQL["manifest_typed"]})
select file_name, brand_name || case when brand_name <> '' then ' é' else '' end as brand_name, class_type, beverage_type,
  alcohol_content, proof, net_contents, producer_bottler, imported, importer, country_of_origin, cola_id, notes from t""")
def manifest_files(spark, sf):
    """The same manifest from CSV files: half of it in UTF-8, half in Latin-1, found out by the probe."""
    folder = scratch(spark)
    brand = F.when(F.col("Brand") == "N/A", F.col("Brand")).otherwise(F.concat("Brand", F.lit("é ")))
    raw = _raw_manifest(spark, sf).withColumn("Brand", brand)
    for part, encoding in ((0, "UTF-8"), (1, "ISO-8859-1")):
        raw.where(F.col("row_id") % 2 == part).drop("row_id").write.csv(
            f"{folder}/{part}", header=True, escape='"', encoding=encoding)
    typed = load_manifest(spark, [f"{folder}/0", f"{folder}/1"], multi_line=False)
    return typed.drop("row_id").withColumn("cola_id", F.substring("cola_id", 1, 10))


# --- names: manifest rows repeat under other cases, uploads are renamed, repeated and extra --

MANIFEST = f"""
select row_id, file_name, brand_name, class_type, beverage_type, alcohol_content, proof, net_contents,
  producer_bottler, imported, importer, country_of_origin, cola_id, notes from ({FIXTURE}) a
union all
select 1000000000 + s_suppkey, case when s_suppkey % 2 = 0 then upper('label_' || lpad(cast(s_suppkey as string), 9, '0') || '.png')
    else 'label_' || lpad(cast(s_suppkey as string), 9, '0') || '.png' end,
  s_name, 'Vodka', 'Distilled Spirits', 40.0, 80.0, '750 mL', s_name, false, '', '', '', 'second listing'
from supplier"""
UPLOADS = f"""
select row_id, case when row_id % 7 = 0 then 'extra_' || cast(row_id as string) || '.png'
    when row_id % 3 = 0 then upper(file_name) else file_name end as file_name,
  raw_text, ocr_seconds, quality_note from ({FIXTURE}) a
union all
select 2000000000 + n_nationkey, 'Label_' || lpad(cast(n_nationkey as string), 9, '0') || '.PNG', 'second scan of ' || n_name,
  cast(1.5 as double), '' from nation"""


def _sides(spark, sf):
    parts = {n: table(spark, sf, n) for n in ("part", "nation", "supplier")}

    def run(sql):
        for name in parts:
            sql = sql.replace(f"from {name}", f"from {{{name}}}").replace(
                f"join {name}", f"join {{{name}}}")
        return spark.sql(sql, **{n: parts[n] for n in parts if f"{{{n}}}" in sql})

    uploads = run(UPLOADS)
    note = F.col("quality_note")
    return run(MANIFEST), uploads.withColumn("image_quality_notes", F.when(
        note != "", F.array(note)).otherwise(F.array().cast("array<string>")))


NAMES = f"""
with mf as ({MANIFEST}), up as ({UPLOADS}),
m as (select *, lower(trim(file_name)) as key from mf), u as (select *, lower(trim(file_name)) as key from up)
"""


def _named(condition, side="m"):
    return NAMES + (f"select file_name, count(*) as occurrences from {side} where {condition} "
                    "group by file_name")


@query("match_matched", _named("key in (select key from u)"))
def match_matched(spark, sf):
    return matching.matched_names(*_sides(spark, sf))


@query("match_missing", _named("key not in (select key from u)"))
def match_missing(spark, sf):
    return matching.missing_names(*_sides(spark, sf))


@query("match_extra", _named("key not in (select key from m)", "u"))
def match_extra(spark, sf):
    return matching.extra_names(*_sides(spark, sf))


_DUPLICATES = """(select distinct file_name from (select file_name,
  row_number() over (partition by key order by row_id) as n from m) where n > 1)"""


@query("match_duplicates", NAMES + "select * from " + _DUPLICATES)
def match_duplicates(spark, sf):
    return matching.duplicate_names(_sides(spark, sf)[0])


@query("match_last_records", NAMES + """
select key, row_id, brand_name, occurrences from (select *,
  row_number() over (partition by key order by row_id desc) as n,
  count(*) over (partition by key) as occurrences from m) where n = 1""")
def match_last_records(spark, sf):
    return matching.last_records(_sides(spark, sf)[0]).select(
        "key", "row_id", "brand_name", "occurrences")


@query("match_last_uploads", NAMES + """
select key, max(row_id) as upload_row, arg_max(file_name, row_id) as upload_name, count(*) as uploads
from u group by key""")
def match_last_uploads(spark, sf):
    return matching.last_uploads(_sides(spark, sf)[1])


@query("match_upload_warnings", NAMES + """
select 'Duplicate uploaded file name encountered: ' || file_name as warning, uploads - 1 as times
from (select file_name, row_number() over (partition by key order by row_id desc) as n,
        count(*) over (partition by key) as uploads from u) where n = 1 and uploads > 1
union all
select 'Uploaded file did not have a matching manifest row and was skipped: ' || file_name, count(*)
from u where key not in (select key from m) group by file_name""")
def match_upload_warnings(spark, sf):
    manifest, files = _sides(spark, sf)
    return matching.duplicate_upload_warnings(files).unionByName(
        matching.extra_upload_warnings(manifest, files))


_VALIDATION = f"""
select (missing + repeats) = 0 as is_valid, total_m as total_manifest_rows, total_u as total_uploaded_files,
  matched as matched_files, missing as missing_files, extra as extra_files, repeats as duplicate_manifest_files,
  concat_ws('; ', case when missing > 0 then 'Manifest rows without uploaded label files: ' || missing end,
    case when repeats > 0 then 'Duplicate manifest file names: ' || repeats end) as errors,
  concat_ws('; ', case when extra > 0 then 'Uploaded label files without manifest rows: ' || extra end) as warnings
from (select (select count(*) from m) as total_m, (select count(*) from u) as total_u,
  (select count(*) from m where key in (select key from u)) as matched,
  (select count(*) from m where key not in (select key from u)) as missing,
  (select count(*) from u where key not in (select key from m)) as extra,
  (select count(*) from {_DUPLICATES}) as repeats)"""


@query("match_validation", NAMES + _VALIDATION)
def match_validation(spark, sf):
    record = matching.validation_record(*_sides(spark, sf))
    return record.withColumns({c: F.array_join(c, "; ") for c in ("errors", "warnings")})


@query("match_exact_names", NAMES + """
select file_name, case when e and p then 'matched' when e then 'missing' else 'extra' end as state
from (select coalesce(a.file_name, b.file_name) as file_name, a.file_name is not null as e,
        b.file_name is not null as p
      from (select distinct file_name from m) a full join (select distinct file_name from u) b
        on a.file_name = b.file_name)""")
def match_exact_names(spark, sf):
    return matching.exact_name_match(*_sides(spark, sf))


@query("match_readiness", NAMES + """
select true as is_ready, 'Manifest + Artwork Batch' as mode,
  'Ready to run manifest-driven batch verification.' as message
where exists (select 1 from m join u on m.file_name = u.file_name)""")
def match_readiness(spark, sf):
    return matching.readiness(*_sides(spark, sf))


@query("missing_file_reports", NAMES + """
select file_name, count(*) as occurrences, 'batch_processing_error' as rule_id,
  'Batch Processing' as field_name, 'Needs Review' as status, 'High' as severity,
  'Manifest row did not have a matching uploaded label file. Human review required.' as message
from m where key not in (select key from u) group by file_name""")
def missing_file_reports(spark, sf):
    rows = batch.missing_reports(*_sides(spark, sf), F.lit(CREATED).cast("timestamp"))
    return rp.detail_rows(rows, "occurrences").select(
        "file_name", "occurrences", "rule_id", "field_name", "status", "severity", "message")


_BATCH = NAMES + """,
rec as (select * from (select *, row_number() over (partition by key order by row_id desc) as n,
          count(*) over (partition by key) as occurrences from m) where n = 1),
txt as (select * from (select *, row_number() over (partition by key order by row_id desc) as n from u) where n = 1),
b as (select t.file_name, r.brand_name, r.alcohol_content, r.occurrences, t.raw_text, t.ocr_seconds,
        try_cast(nullif(regexp_extract(t.raw_text, '(\\d{1,3}(?:\\.\\d+)?)\\s*%?\\s*(?:alc\\.?\\s*/?\\s*vol\\.?|abv|alcohol\\s+by\\s+volume)', 1, 'i'), '') as double) as abv
      from rec r join txt t using (key))
"""
_ABV_STATUS = """case when coalesce(alcohol_content, 0) = 0 then 'Needs Review' when abv is null then 'Fail'
  when abv <> 0 and abs(alcohol_content - abv) <= 0.25 then 'Pass' else 'Fail' end"""


@query("batch_reports", _BATCH + f"""
select file_name, brand_name, occurrences, true as processed, ocr_seconds as processing_seconds,
  case when raw_text = '' then 'ocr_text_extraction' else 'alcohol_content_match' end as rule_id,
  case when raw_text = '' then 'Needs Review' else {_ABV_STATUS} end as status from b
union all
select file_name, '', count(*), false, 0.0::double, 'batch_processing_error', 'Needs Review'
from m where key not in (select key from u) group by file_name""")
def batch_reports(spark, sf):
    table_ = batch.verify_batch(*_sides(spark, sf), created_on=F.lit(CREATED).cast("timestamp"))
    rows = rp.detail_rows(table_, "brand_name", "occurrences", "processed", "processing_seconds")
    return rows.where(F.col("rule_id").isin(
        "alcohol_content_match", "ocr_text_extraction", "batch_processing_error")).select(
        "file_name", "brand_name", "occurrences", "processed", "processing_seconds", "rule_id",
        "status")


@query("batch_occurrences", _BATCH + """
select file_name, count(*) as listings from (
  select b.file_name, unnest(range(b.occurrences)) from b) group by file_name""")
def batch_occurrences(spark, sf):
    made = batch.matched_labels(*_sides(spark, sf)).select("file_name", "occurrences")
    return batch.expand_occurrences(made).groupBy("file_name").agg(
        F.count("*").alias("listings"))


def _run(spark, sf):
    """A batch over uploads that carry a folder and no row ids: the last upload is then the one
    with the greatest digest, so each name has one text here."""
    manifest, uploads = _sides(spark, sf)
    last = matching.last_uploads(uploads).select(F.col("upload_row").alias("row_id"))
    single = uploads.join(last, "row_id").drop("row_id").withColumn(
        "file_name", F.concat(F.lit("/in/"), "file_name"))
    return batch.run_manifest_batch(manifest, single, created_on=F.lit(CREATED).cast("timestamp"))


_LISTED = _BATCH + """, listed as (
  select b.file_name, b.brand_name, b.ocr_seconds, true as processed, unnest(range(b.occurrences)) as i from b
  union all
  select file_name, '', 0.0::double, false, unnest(range(count(*)))
  from m where key not in (select key from u) group by file_name)
"""


@query("batch_outputs_reports", _LISTED + """
select file_name, brand_name, processed, ocr_seconds as processing_seconds, count(*) as listings
from listed group by all""")
def batch_outputs_reports(spark, sf):
    rows = batch.expand_occurrences(_run(spark, sf).reports)
    return rows.groupBy("file_name", "brand_name", "processed", "processing_seconds").agg(
        F.count("*").alias("listings"))


@query("batch_outputs_summary", _LISTED + """
select file_name as "File Name", count(*) as listings from listed group by all""")
def batch_outputs_summary(spark, sf):
    return _run(spark, sf).summary.groupBy("File Name").agg(F.count("*").alias("listings"))


@query("batch_outputs_details", _LISTED + """
select file_name as "File Name", count(*) as least, count(*) as most from listed group by all""")
def batch_outputs_details(spark, sf):
    """Every rule of a label has a detail row for each listing of its name."""
    rows = _run(spark, sf).details.groupBy("File Name", "Rule ID").agg(F.count("*").alias("n"))
    return rows.groupBy("File Name").agg(F.min("n").alias("least"), F.max("n").alias("most"))


@query("batch_outputs_performance", _LISTED + """
select file_name as "File Name", round(ocr_seconds::decimal(30,12), 3)::double as "Processing Seconds",
  ocr_seconds <= 5 as "Within SLA", count(*) as listings from listed where processed group by all""")
def batch_outputs_performance(spark, sf):
    return _run(spark, sf).performance.groupBy("File Name", "Processing Seconds", "Within SLA").agg(
        F.count("*").alias("listings"))


_ROUND3 = "round({0}::decimal(30,12), {1})::double"


def r3(x, digits=3):
    return _ROUND3.format(x, digits)


_BATCH_TIMES = """, times as (select unnest(range(occurrences::int)) as i, ocr_seconds as s from b),
ts as (select count(*) as n, avg(s) as average, quantile_cont(s, 0.5) as med, quantile_cont(s, 0.95) as p95,
  max(s) as top, count(*) filter (s > 5) as breaches, sum(s) as total from times)"""
_MET = "(average <= 5 and p95 <= 5 and breaches = 0)"


@query("batch_summary", _BATCH + _BATCH_TIMES + f""",
v as ({_VALIDATION}),
sk as (select count(*) as skipped from (select distinct file_name from m where key not in (select key from u)
       union all select distinct file_name from u where key not in (select key from m)))
select n as "Processed Files", skipped as "Skipped Files", is_valid as "Manifest Valid",
  total_manifest_rows as "Manifest Rows", total_uploaded_files as "Uploaded Files",
  matched_files as "Matched Files", missing_files as "Missing Files", extra_files as "Extra Files",
  {r3('average')} as "Average Seconds", {r3('med')} as "Median Seconds", {r3('p95')} as "P95 Seconds",
  {r3('top')} as "Maximum Seconds", 5.0::double as "SLA Seconds", breaches as "SLA Breaches",
  {r3('breaches / n', 4)} as "SLA Breach Rate", {r3('n / total * 60')} as "Throughput Labels Per Minute",
  case when {_MET} then 'Met' else 'Not Met' end as "SLA Acceptance",
  case when n < 20 then 'Not Evaluated' when n <= 50 then 'Met' else 'Not Met' end as "Batch Size Acceptance",
  'Not Met' as "Overall Acceptance",
  'Overall acceptance: Not Met. Processed ' || n || ' timed files. SLA acceptance: ' ||
    case when {_MET} then 'Met' else 'Not Met' end || '. Batch-size acceptance: ' ||
    case when n < 20 then 'Not Evaluated' when n <= 50 then 'Met' else 'Not Met' end || '.' as "Acceptance Message",
  (case when missing_files > 0 then 1 else 0 end + case when duplicate_manifest_files > 0 then 1 else 0 end) as "Errors",
  case when extra_files > 0 then 1 else 0 end + extra_files as "Warnings"
from ts, v, sk""")
def batch_summary(spark, sf):
    manifest, uploads = _sides(spark, sf)
    rows = batch.matched_labels(manifest, uploads).select(
        "file_name", F.col("ocr_seconds").alias("processing_seconds"), "occurrences")
    timing = performance.timing_summary(rows, weight="occurrences")
    skipped = matching.missing_names(manifest, uploads).select("file_name").unionByName(
        matching.extra_names(manifest, uploads).select("file_name"))
    return performance.batch_summary(
        matching.validation_record(manifest, uploads), performance.batch_acceptance(timing),
        skipped)


# --- one application over many texts ---------------------------------------------------------

_APPLICATION = Application(
    brand_name="The", class_type="Red Wine", beverage_type="Wine", alcohol_content=13.5,
    net_contents="750 mL", producer_bottler="Stone's Throw Winery", imported=True)


@query("one_application_conversations", r"""
select conv_id, turn, rule_id, status from (
  select conv_id, turn,
    unnest(['alcohol_content_present', 'producer_bottler_present', 'proof_present', 'importer_present']) as rule_id,
    unnest([case when regexp_matches(text, '(\d{1,3}(?:\.\d+)?)\s*%?\s*(?:alc\.?\s*/?\s*vol\.?|abv|alcohol\s+by\s+volume)', 'i') then 'Pass' else 'Fail' end,
      case when regexp_matches(text, '(bottled\s+by|distilled\s+by|produced\s+by|vinted\s+by|brewed\s+by|cellared\s+by|packed\s+by)', 'i') then 'Pass' else 'Fail' end,
      'Not Applicable',
      case when regexp_matches(text, '(imported\s+by|imported\s+for|sole\s+importer|importer)', 'i') then 'Pass' else 'Fail' end]) as status
  from conversations where trim(text) <> '')
union all select conv_id, turn, 'ocr_text_extraction', 'Needs Review' from conversations where trim(text) = ''""")
def one_application_conversations(spark, sf):
    texts = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("file_name"), F.col("text").alias("raw_text"))
    checked_ = batch.verify_application(_APPLICATION, texts, created_on=F.lit(CREATED).cast("timestamp"))
    wanted = ("alcohol_content_present", "producer_bottler_present", "proof_present",
              "importer_present", "ocr_text_extraction")
    rows = rp.detail_rows(checked_).where(F.col("rule_id").isin(*wanted))
    ids = F.split("file_name", "-")
    return rows.select(ids[0].cast("bigint").alias("conv_id"), ids[1].cast("bigint").alias("turn"),
                       "rule_id", "status")


@query("manual_text_labels", """
select conv_id || '-' || turn || '.txt' as file_name, 'txt' as file_type, text as raw_text,
  trim(text) <> '' as has_text, 'manual' as ocr_engine, 0.0::double as ocr_seconds,
  'Manual text verification path used; OCR was not executed.' as notes from conversations""")
def manual_text_labels(spark, sf):
    texts = table(spark, sf, "conversations").select(
        F.concat(F.lit("/in/"), F.concat_ws("-", "conv_id", "turn"), F.lit(".txt"))
        .alias("file_name"), F.col("text").alias("raw_text"))
    made = label_text(texts, manual=True)
    return made.drop("row_id").withColumn(
        "notes", F.array_join("image_quality_notes", "; ")).drop("image_quality_notes")


# --- timings: events carry seconds, one batch per user. Sevenths make rounding ties rare; the
# ones interpolation still produces are settled by the rounding in batch_acceptance. --


def _timings(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("batch_id"), F.concat(F.lit("e"), "event_id").alias("file_name"),
        (F.col("value") / 7.0).alias("processing_seconds"), F.col("ts").alias("started_on"))


_EV = "ev as (select user_id as batch_id, 'e' || event_id as file_name, greatest(value / 7.0, 0) as s, ts from events)"


@query("sla_labels", f"""
with {_EV}
select file_name as "File Name", {r3('s')} as "Processing Seconds", 5.0::double as "SLA Seconds",
  s <= 5 as "Within SLA", {r3('greatest(s - 5, 0)')} as "SLA Breach Seconds",
  case when s <= 5 then 'Pass' else 'Warning' end as "SLA Status",
  strftime(ts, '%Y-%m-%d %H:%M:%S') as "Started On" from ev""")
def sla_labels(spark, sf):
    # The message prints seconds with three decimals and is compared in sla_messages.
    return performance.performance_table(_timings(spark, sf)).drop("Performance Message")


@query("sla_messages", f"""
with {_EV}
select file_name, 'Processed in ' || format('{{:.3f}}', s) || ' seconds, ' ||
  case when s <= 5 then 'within' else 'exceeding' end || ' the 5.000-second SLA.' as message from ev""")
def sla_messages(spark, sf):
    return performance.label_timings(_timings(spark, sf)).select(
        "file_name", F.col("performance_message").alias("message"))


def _stats(group):
    keys = "batch_id, " if group else ""
    return f"""with {_EV}, st as (select {keys}count(*) as total_files, avg(s) as average, max(s) as top,
  min(s) as low, quantile_cont(s, 0.5) as p50, quantile_cont(s, 0.9) as p90, quantile_cont(s, 0.95) as p95,
  count(*) filter (s <= 5) as within_sla_count, sum(s) as total, count(*) filter (s > 5) as breaches
  from ev {'group by batch_id' if group else ''})"""


_SUMMARY = f"""total_files, {r3('average', 6)} as average_seconds, {r3('top', 6)} as maximum_seconds,
  {r3('low', 6)} as minimum_seconds, {r3('p50', 6)} as median_seconds, {r3('p50', 6)} as p50_seconds,
  {r3('p90', 6)} as p90_seconds, {r3('p95', 6)} as p95_seconds, within_sla_count,
  breaches as sla_breach_count, {r3('breaches / total_files', 6)} as sla_breach_rate, 5.0::double as sla_seconds,
  {r3('total', 6)} as total_seconds"""


def _rounded(df):
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, 6) for c in doubles})


@query("sla_summary_by_batch", _stats(True) + f" select batch_id, {_SUMMARY} from st")
def sla_summary_by_batch(spark, sf):
    return _rounded(performance.timing_summary(_timings(spark, sf), by=("batch_id",)))


@query("sla_summary_total", _stats(False) + f" select {_SUMMARY} from st")
def sla_summary_total(spark, sf):
    return _rounded(performance.timing_summary(_timings(spark, sf)))


@query("sla_rollup", f"""with {_EV}, st as (select batch_id, grouping(batch_id) as level, count(*) as total_files,
  avg(s) as average, max(s) as top, min(s) as low, quantile_cont(s, 0.5) as p50, quantile_cont(s, 0.9) as p90,
  quantile_cont(s, 0.95) as p95, count(*) filter (s <= 5) as within_sla_count, sum(s) as total,
  count(*) filter (s > 5) as breaches from ev group by rollup(batch_id))
select level::int as level, batch_id, {_SUMMARY} from st""")
def sla_rollup(spark, sf):
    return _rounded(performance.timing_rollup(_timings(spark, sf)))


def _met(x):
    return f"({x})"


@query("sla_acceptance", _stats(True) + """
select batch_id, average <= 5 as meets_average_target, p95 <= 5 as meets_p95_target,
  breaches = 0 as meets_breach_rate_target, average <= 5 and p95 <= 5 and breaches = 0 as meets_acceptance,
  case when average <= 5 and p95 <= 5 and breaches = 0 then 'Met' else 'Not Met' end as acceptance_status,
  5.0::double as average_target_seconds, 5.0::double as p95_target_seconds, 0.0::double as max_breach_rate from st""")
def sla_acceptance(spark, sf):
    done = performance.timing_acceptance(
        performance.timing_summary(_timings(spark, sf), by=("batch_id",)))
    return done.select(
        "batch_id", "meets_average_target", "meets_p95_target", "meets_breach_rate_target",
        "meets_acceptance", "acceptance_status", "average_target_seconds",
        "p95_target_seconds", "max_breach_rate")


@query("sla_evidence", _stats(True) + """
select batch_id, total_files > 0 as sla_tested, breaches = 0 as under_five_seconds_per_label,
  average <= 5 as meets_average_target, p95 <= 5 as meets_p95_target, breaches = 0 as meets_zero_breach_target,
  average <= 5 and p95 <= 5 and breaches = 0 as meets_acceptance,
  case when average <= 5 and p95 <= 5 and breaches = 0 then 'Performance evidence passed for '
       else 'Performance evidence did not pass for ' end || total_files || ' timed labels.' as message
from st""")
def sla_evidence(spark, sf):
    done = performance.timing_evidence(performance.timing_acceptance(
        performance.timing_summary(_timings(spark, sf), by=("batch_id",))), by=("batch_id",))
    return done.withColumn("message", F.regexp_extract("message", r"^(.*? timed labels\.)", 1))


@query("batch_acceptance", _stats(True) + f"""
, j as (select *, case when average <= 5 and p95 <= 5 and breaches = 0 then 'Met' else 'Not Met' end as sla_acceptance,
  case when total_files < 20 then 'Not Evaluated' when total_files <= 50 then 'Met' else 'Not Met' end as size_ok from st),
o as (select *, case when sla_acceptance = 'Met' and size_ok = 'Met' then 'Met'
  when sla_acceptance = 'Met' and size_ok = 'Not Evaluated' then 'Partially Evaluated' else 'Not Met' end as overall from j)
select batch_id, total_files as processed_files, 20 as minimum_files, 50 as maximum_files,
  {r3('average')} as average_seconds, {r3('p50')} as median_seconds, {r3('p95')} as p95_seconds,
  {r3('top')} as maximum_seconds, 5.0::double as sla_seconds, breaches as sla_breaches,
  {r3('breaches / total_files', 4)} as sla_breach_rate, {r3('total_files / total * 60')} as throughput_per_minute,
  sla_acceptance, size_ok as batch_size_acceptance, overall as overall_acceptance,
  'Overall acceptance: ' || overall || '. Processed ' || total_files || ' timed files. SLA acceptance: ' ||
  sla_acceptance || '. Batch-size acceptance: ' || size_ok || '.' as acceptance_message from o""")
def batch_acceptance(spark, sf):
    timing = performance.timing_summary(_timings(spark, sf), by=("batch_id",))
    return performance.batch_acceptance(timing, by=("batch_id",))


@query("dashboard", DETAILS + f""", ev as (select value / 7.0 as s from events)
select count(*) as total_files, count(*) filter (failed) as total_failures, count(*) filter (warned) as total_warnings,
  count(*) filter (reviewed) as total_reviews, (select count(*) filter (s > 5) from ev) as sla_breaches
from (select file_name, bool_or(status = 'Fail') as failed, bool_or(status = 'Warning') as warned,
        bool_or(status = 'Needs Review' or requires_human_review) as reviewed from details group by file_name)""")
def dashboard(spark, sf):
    return rp.dashboard(checked(spark, sf), performance.timing_summary(_timings(spark, sf)))


# --- image quality: an embedding read as an 8 x 8 gray image ----------------------------------


def _pixels(spark, sf):
    cells = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "v"))
    gray = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(
        F.lit(127.0) + F.col("v").cast("double") * 600).cast("int")))
    return cells.select(
        "image_id", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"),
        gray.alias("gray"))


_PIX = """px as (select vec_id as image_id, pos % 8 as x, pos // 8 as y,
  least(255, greatest(0, floor(127.0 + v::double * 600)::int)) as g
  from (select vec_id, unnest(embedding) as v, unnest(range(64)) as pos from embeddings)),
lap as (select p.image_id, p.g, p.x, p.y,
    coalesce(l.g, r.g) + coalesce(r.g, l.g) + coalesce(a.g, b.g) + coalesce(b.g, a.g) - 4 * p.g as d
  from px p left join px l on l.image_id = p.image_id and l.y = p.y and l.x = p.x - 1
    left join px r on r.image_id = p.image_id and r.y = p.y and r.x = p.x + 1
    left join px a on a.image_id = p.image_id and a.x = p.x and a.y = p.y - 1
    left join px b on b.image_id = p.image_id and b.x = p.x and b.y = p.y + 1),
met as (select image_id, max(x) + 1 as width, max(y) + 1 as height, avg(g) as brightness,
    stddev_pop(g) as contrast, var_pop(d) as blur_score, avg((g >= 245)::int) as glare_ratio,
    avg((g <= 35)::int) as dark_ratio from lap group by image_id)"""
_METRICS = ("brightness", "contrast", "blur_score", "glare_ratio", "dark_ratio")


@query("pixel_statistics", f"with {_PIX} select image_id, width, height, " + ", ".join(
    f"round({m}, 6) as {m}" for m in _METRICS) + " from met")
def pixel_statistics(spark, sf):
    return quality.pixel_statistics(_pixels(spark, sf)).withColumns(
        {m: F.round(m, 6) for m in _METRICS})


# Metrics on a grid of sizes, contrasts and angles derived from documents.
_DOC_METRICS = """dm as (select doc_id, (n_chars % 1601)::int as width, (n_chars % 1301)::int as height,
  (n_chars % 256)::double as brightness, (n_chars % 61)::double as contrast, (n_chars % 131)::double as blur_score,
  (n_chars % 11) / 20.0 as glare_ratio, (n_chars % 9) / 20.0 as dark_ratio, (n_chars % 25) / 2.0 - 6.0 as skew_angle
  from documents)"""


def _doc_metrics(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select(
        "doc_id", (n % 1601).cast("int").alias("width"), (n % 1301).cast("int").alias("height"),
        (n % 256).cast("double").alias("brightness"), (n % 61).cast("double").alias("contrast"),
        (n % 131).cast("double").alias("blur_score"), ((n % 11) / 20.0).alias("glare_ratio"),
        ((n % 9) / 20.0).alias("dark_ratio"), ((n % 25) / 2.0 - 6.0).alias("skew_angle"))


_SCORED = _DOC_METRICS + """,
sc as (select *, least(100, greatest(0, least(100, greatest(0, contrast / 20 * 100)) * 0.40
  + least(100, greatest(0, blur_score / 35 * 100)) * 0.45 + 15 - least(25, glare_ratio / 0.35 * 25)
  - least(35, dark_ratio / 0.25 * 35) - least(25, abs(skew_angle) / 8 * 25))) as score from dm)"""
_WARN = (
    ("width < 800 or height < 800", "Image resolution is below the preferred OCR size.", "Request a higher-resolution label image."),
    ("brightness < 60", "Image appears underexposed or too dark.", "Request a brighter image or improve lighting."),
    ("brightness > 245 and contrast < 20", "Image appears overexposed or washed out.", "Request a retake without overexposure."),
    ("contrast < 20", "Image contrast may be too low for reliable OCR.", "Increase contrast or request clearer artwork."),
    ("blur_score < 35", "Image may be blurry.", "Request a sharper image or direct artwork export."),
    ("glare_ratio > 0.35 and contrast < 45", "Possible glare or washed-out image areas detected.", "Request an image without glare or reflections."),
    ("dark_ratio > 0.25", "Large dark areas may reduce OCR reliability.", "Request better lighting or a direct digital label."),
    ("abs(skew_angle) > 8", "Image appears skewed or rotated.", "Deskew image or request a straight-on label image."),
    ("score < 50", "Overall readability is low.", "Manual review or resubmission is recommended."),
)


def _joined(column, lead="", sep=" / "):
    return f"concat_ws('{sep}', " + ", ".join(
        f"case when {w[0]} then '{lead}{w[column]}' end" for w in _WARN) + ")"


_BANDS = """case when score >= 75 then 'Pass' when score >= 55 then 'Warning' when score >= 35 then 'Needs Review'
  else 'Fail' end"""


@query("quality_verdict", f"""
with {_SCORED}
select doc_id, round(score, 6) as readability_score, {_BANDS} as status,
  case when score >= 75 then 'Info' when score >= 55 then 'Low' when score >= 35 then 'Medium' else 'High' end as severity,
  {_joined(1)} as warnings, {_joined(2)} as recommendations,
  case when glare_ratio >= 0.18 then 'glare_review' when dark_ratio >= 0.30 or brightness < 70 then 'dark_image'
       when brightness > 230 then 'overexposed' when contrast < 28 then 'low_contrast'
       when blur_score < 80 then 'blur_review' else 'standard' end as profile
from sc""")
def quality_verdict(spark, sf):
    done = quality.quality_verdict(_doc_metrics(spark, sf))
    return done.select(
        "doc_id", F.round("readability_score", 6).alias("readability_score"), "status",
        "severity", F.array_join("warnings", " / ").alias("warnings"),
        F.array_join("recommendations", " / ").alias("recommendations"),
        quality.preprocessing_profile().alias("profile"))


@query("quality_notes", f"""
with {_DOC_METRICS}, n as (select doc_id, concat_ws(' / ',
  case when width < 800 or height < 800 then 'Image is smaller than preferred OCR dimensions.' end,
  case when brightness < 60 then 'Image may be too dark for reliable OCR.' end,
  case when brightness > 235 then 'Image may be overexposed for reliable OCR.' end,
  case when contrast < 25 then 'Image may have low contrast.' end,
  case when blur_score < 80 then 'Image may be blurry; OCR results require careful review.' end,
  case when glare_ratio >= 0.18 then 'Image may contain glare or excessive bright regions; this prototype flags glare risk but does not perform true glare removal.' end,
  case when dark_ratio >= 0.30 then 'Image contains a large dark region that may reduce OCR reliability.' end,
  case when abs(skew_angle) >= 1 then 'Image may be skewed by approximately ' || format('{{:.1f}}', skew_angle) || ' degrees.' end) as issues,
  'Image metrics: ' || width || 'x' || height || '; brightness ' || format('{{:.1f}}', brightness) || '; contrast ' ||
  format('{{:.1f}}', contrast) || '; blur ' || format('{{:.1f}}', blur_score) || '; glare ' || format('{{:.3f}}', glare_ratio)
  || '; dark ' || format('{{:.3f}}', dark_ratio) || '; skew ' || format('{{:.1f}}', skew_angle) || '.' as lead from dm)
select doc_id, lead || ' / ' || case when issues = '' then 'No obvious image quality issues detected.' else issues end as notes
from n""")
def quality_notes(spark, sf):
    return _doc_metrics(spark, sf).select(
        "doc_id", F.array_join(quality.preprocessing_notes(), " / ").alias("notes"))


@query("quality_label_notes", f"""
with {_SCORED}
select doc_id, concat_ws(' / ', 'Visual quality status: ' || {_BANDS} || '.',
  nullif({_joined(1, 'Visual warning: ')}, ''), nullif({_joined(2, 'Visual recommendation: ')}, '')) as notes from sc""")
def quality_label_notes(spark, sf):
    done = quality.quality_verdict(_doc_metrics(spark, sf))
    # The second and third note repeat the numbers that quality_verdict compares.
    notes = F.filter(quality.verdict_notes(), lambda n: ~n.rlike("^(Readability|Brightness)"))
    return done.select("doc_id", F.array_join(notes, " / ").alias("notes"))


# --- redaction, exports, logs, retention ----------------------------------------------------


def _customers(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("Rule ID"), F.col("c_name").alias("Brand Name"),
        F.col("c_mktsegment").alias("Expected"),
        F.when(F.col("c_nationkey") % 4 == 0, " ").otherwise(F.col("c_mktsegment"))
        .alias("Observed"),
        F.col("c_acctbal").alias("Beverage Type"), F.col("c_nationkey").alias("Evidence"),
        F.when(F.col("c_nationkey") % 3 != 0, F.col("c_name")).alias("Message"),
        F.col("c_mktsegment").alias("Explanation"), F.col("c_name").alias("country_of_origin"))


_CUSTOMERS = f"""select c_custkey as "Rule ID", c_name as "Brand Name", '{REDACTED}' as "Expected",
  case when c_nationkey % 4 = 0 then '' else '{REDACTED}' end as "Observed", '{REDACTED}' as "Beverage Type",
  c_nationkey as "Evidence", case when c_nationkey % 3 <> 0 then '{REDACTED}' else '' end as "Message",
  c_mktsegment as "Explanation", c_name as "country_of_origin" from customer"""


@query("redact_table", _CUSTOMERS)
def redact_table(spark, sf):
    return redaction.redact_table(_customers(spark, sf))


@query("redact_audit", """select true as redaction_applied, 4 as redacted_field_count,
  'Expected, Observed, Beverage Type, Message' as redacted_fields,
  'Redacted 4 sensitive DataFrame field(s).' as message where exists (select 1 from customer)""")
def redact_audit(spark, sf):
    return redaction.redaction_audit(_customers(spark, sf)).withColumn(
        "redacted_fields", F.array_join("redacted_fields", ", "))


@query("redact_json", f"""
select '{{"cust_id":' || o_custkey || ',"report":{{"status":"' || o_orderstatus || '","expected":"{REDACTED}","items":[{{"rule_id":"'
  || o_orderkey || '","observed":"{REDACTED}"}}]}},"raw_text":"{REDACTED}"}}' as value from orders""")
def redact_json(spark, sf):
    nested = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("cust_id"),
        F.struct(F.col("o_orderstatus").alias("status"),
                 F.col("o_orderpriority").alias("expected"),
                 F.array(F.struct(F.col("o_orderkey").cast("string").alias("rule_id"),
                                  F.col("o_totalprice").alias("observed"))).alias("items"))
        .alias("report"), F.col("o_orderpriority").alias("raw_text"))
    return json_lines(nested)


@query("raw_text_notice", f"""
select page_id, '{TEXT_NOTICE}' as text, '{REDACTED}' as url from pages""")
def raw_text_notice(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", redaction.raw_text_or_notice(F.col("html")).alias("text"),
        redaction.path_or_mask(F.col("url")).alias("url"))


@query("error_log_rows", """
select strftime(ts, '%Y-%m-%d %H:%M:%S') as created_on, event_type as cause, 'module ' || user_id as module,
  'method' as method, '{"k' || substr(props, 4) as message, left(repeat(event_type || ' ', 30), 4000) as trace,
  'token=[SECRET] at [PATH]' as info from (select *, props as p from events)""".replace(
    "left(repeat(event_type || ' ', 30), 4000)", "trim(repeat(event_type || ' ', 30))"))
def error_log_rows(spark, sf):
    errors = table(spark, sf, "events").select(
        F.col("ts").alias("created_on"), F.col("event_type").alias("cause"),
        F.concat(F.lit("module  "), F.col("user_id").cast("string")).alias("module"),
        F.lit("method").alias("method"), F.col("props").alias("message"),
        F.lit("token: abc123 at /tmp/x/y.py").alias("info"),
        F.repeat(F.concat("event_type", F.lit(" ")), 30).alias("trace"))
    rows = redaction.error_log_rows(errors)
    return rows.withColumn("created_on", F.date_format("created_on", "yyyy-MM-dd HH:mm:ss"))


@query("retention_events", """
select event_id, user_id, event_type from events where ts >= timestamp '2024-01-24 00:00:00'""")
def retention_events(spark, sf):
    kept = redaction.retained(table(spark, sf, "events"), dt.datetime(2024, 1, 31), 7, "ts")
    return kept.select("event_id", "user_id", "event_type")


# --- artwork names ---------------------------------------------------------------------------

_MEMBER = """case page_id % 8 when 0 then '/abs/' when 1 then '../up/' when 2 then '__MACOSX/'
  when 3 then 'a/../b/' when 4 then 'dir/.' else 'art/' end || 'p' || page_id || case page_id % 5
  when 0 then '.PNG' when 1 then '.pdf' when 2 then '.txt' when 3 then '.tiff' else '/' end"""


@query("archive_members", f"""
with t as (select page_id, {_MEMBER.replace('page_id ||', 'page_id::varchar ||')} as member, length(html) as size from pages)
select 'pages.zip' as "Source", regexp_extract(member, '[^/]*$') as "File Name",
  round((size / 1024.0)::decimal(20,8), 2)::double as "Size KB", lower(regexp_extract(member, '\\.([a-zA-Z]+)$', 1)) as "Type",
  'ZIP Member' as "Input Type"
from t where page_id % 8 >= 5 and page_id % 5 in (0, 1, 3)
union all
select 'p' || page_id || '.png', 'p' || page_id || '.png', round((size / 1024.0)::decimal(20,8), 2)::double, 'png', 'Uploaded File' from t""")
def archive_members(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", F.expr(_MEMBER).alias("member"), F.length("html").alias("size"))
    name = F.element_at(F.split("member", "/"), -1)
    members = pages.where(artwork.is_safe_member(F.col("member"))).select(
        F.lit("pages.zip").alias("source"), name.alias("file_name"), "size").where(
        artwork.is_supported(F.col("file_name")))
    files = pages.select(F.concat(F.lit("p"), "page_id", F.lit(".png")).alias("file_name"), "size")
    return artwork.inventory(files, members)


# --- requirements and checklists --------------------------------------------------------------

_FACTS = f"""
with fx as ({FIXTURE}),
f as (select count(*) as n, count(*) filter (raw_text <> '') as texts from fx),
ev as (select avg(value / 7.0) as average, quantile_cont(value / 7.0, 0.95) as p95, count(*) as timed,
       count(*) filter (value / 7.0 > 5) as late from events),
a as (select *, average <= 5 and p95 <= 5 and late = 0 as ok from ev, f)
"""
_FLAGS = {"ACCEPTANCE_EXPORT_AVAILABLE": True, "KEYBOARD_ACCESSIBILITY_PASSED": True,
          "AZURE_READY_ARTIFACTS_PRESENT": True, "ENABLE_RAW_OCR_EXPORT": True}
_STATUSES = """
select unnest(range(1, 16)) as ordinal,
  unnest(['1.1','1.2','1.3','1.4','1.5','2.1','2.2','2.3','2.4','3.1','3.2','3.3','4.1','4.2','4.3']) as requirement_id,
  unnest([case when texts > 0 then 'Met' else 'Not Met' end, case when texts > 0 then 'Met' else 'Partially Met' end,
    case when n > 1 then 'Met' else 'Partially Met' end, case when ok then 'Met' else 'Not Met' end, 'Met', 'Met',
    'Partially Met', 'Met', case when n between 20 and 50 then 'Met' else 'Partially Met' end, 'Met', 'Met', 'Met',
    'Partially Met', 'Met', 'Not Met']) as status,
  unnest(['OCR text was produced for ' || texts || ' reports and structured fields were produced for ' || texts || ' reports.',
    'Comparison output, fuzzy rules, exact warning rule, and visual warning rule are present.',
    'Batch run produced ' || n || ' reports and ' || n || ' processed files.', '',
    'Summary, detail, comparison, performance, and acceptance outputs are available.',
    'Default Simple Mode: True; workflow validated: False.',
    'Run produced reports but also had 2 batch-level errors.',
    'Local OCR required: True; external ML endpoints allowed: False; raw text logging enabled: False; no-persistence mode: True; redacted export enabled: True.',
    'Processed/report count is ' || n || '; required range is 20–50.',
    'Large buttons present: True; Simple Mode default: True.',
    'High contrast default: False; large text default: False; keyboard validation passed: True.',
    'Progress evidence: True; confidence evidence: True; non-hover guidance: True.',
    'Deployment target: local; Azure artifacts present: True; Azure smoke test passed: False; local OCR required: True; external ML endpoints allowed: False.',
    'Direct COLA integration enabled: False.',
    'No-persistence mode: True; long-term storage disabled: True; upload persistence enabled: False; raw OCR export enabled: True; extracted data export enabled: False; file path export enabled: False; redacted export enabled: True.'
  ]) as evidence from a"""


def _requirements(spark, sf):
    timing = performance.timing_acceptance(performance.timing_summary(_timings(spark, sf)))
    done = checked(spark, sf)
    facts = evidence.run_facts(done, processed=0, errors=2, performance=timing).withColumn(
        "processed_count", F.col("total_reports"))
    return evidence.requirements(facts, evidence.flags_table(spark, _FLAGS))


@query("evidence_requirements", _FACTS + _STATUSES)
def evidence_requirements(spark, sf):
    rows = _requirements(spark, sf)
    # The timing message carries long decimals; sla_acceptance compares its parts.
    return rows.select("ordinal", "requirement_id", "status", F.when(
        F.col("requirement_id") == "1.4", "").otherwise(F.col("evidence")).alias("evidence"))


@query("evidence_rollup", _FACTS + f""", s as ({_STATUSES}),
c as (select count(*) filter (status = 'Met') as met, count(*) filter (status = 'Partially Met') as partially_met,
  count(*) filter (status = 'Not Met') as not_met, count(*) filter (status = 'Not Applicable') as not_applicable,
  count(*) filter (status <> 'Not Applicable') as applicable from s)
select met, partially_met, not_met, not_applicable, round((met / applicable * 100)::decimal(20,10), 2)::double as acceptance_percentage,
  case when not_met > 0 then 'Fail' when partially_met > 0 then 'Partial' when met > 0 then 'Pass' else 'Not Evaluated' end as verdict
from c""")
def evidence_rollup(spark, sf):
    rollup = evidence.requirement_rollup(_requirements(spark, sf))
    return rollup.withColumn("verdict", evidence.run_verdict(
        F.lit(0), F.col("met"), F.col("partially_met"), F.col("not_met"), F.lit(0)))


@query("evidence_facts", DETAILS + """
select count(*) as total_reports, count(*) filter (raw_text <> '') as ocr_text_count,
  count(*) filter (raw_text <> '') as structured_count, count(*) as rule_report_count,
  (select count(distinct file_name) from details where status in ('Fail', 'Warning', 'Needs Review')
     or requires_human_review) as review_or_failure_count,
  true as has_fuzzy_rules, true as has_exact_rule, true as has_visual_rule from fx""")
def evidence_facts(spark, sf):
    return evidence.report_facts(checked(spark, sf))


# Checklists: one per customer, its orders are the items.
_ITEMS = """items as (select o_custkey as checklist, 'DEPLOY-00' || (o_orderkey % 9 + 1) as item_id,
  'item ' || o_orderkey as name,
  case o_orderkey % 13 when 0 then 'Not Met' when 1 then 'Partially Met' when 2 then 'Not Evaluated' else 'Met' end as status
  from orders)"""
_CHECKS = """items as (select o_custkey as checklist, 'A-' || o_orderkey as item_id, 'item ' || o_orderkey as name,
  case o_orderkey % 31 when 0 then 'Fail' when 1 then 'Not Tested' when 2 then 'Not Applicable' else 'Pass' end as status,
  '' as notes from orders)"""


def _items(spark, sf, sql):
    body = sql[sql.index("(") + 1:-1].replace("from orders", "from {orders}")
    return spark.sql(body, orders=table(spark, sf, "orders"))


@query("checklist_rollup", f"""with {_ITEMS}, c as (
select checklist, count(*) as items, count(*) filter (status = 'Met') as met, count(*) filter (status = 'Partially Met') as partially_met,
  count(*) filter (status = 'Not Met') as not_met, count(*) filter (status = 'Not Evaluated') as not_evaluated
from items group by checklist)
select *, case when not_met > 0 then 'Not Met' when partially_met + not_evaluated > 0 then 'Partially Met' else 'Met' end as overall_status
from c""")
def checklist_rollup(spark, sf):
    return checklists.evidence_rollup(_items(spark, sf, _ITEMS))


@query("accessibility_rollup", f"""with {_CHECKS}, c as (
select checklist, count(*) filter (status = 'Pass') as passed, count(*) filter (status = 'Fail') as failed,
  count(*) filter (status = 'Not Tested') as untested, count(*) filter (status = 'Not Applicable') as not_applicable
from items group by checklist)
select *, case when failed > 0 then 'Not Met' when untested > 0 then 'Partially Met' else 'Met' end as overall_status,
  case when failed > 0 then failed || ' accessibility checklist item(s) failed and require remediation before acceptance.'
       when untested > 0 then untested || ' accessibility checklist item(s) remain untested. Manual browser validation is required.'
       else 'All applicable accessibility checklist items passed.' end as message from c""")
def accessibility_rollup(spark, sf):
    return checklists.accessibility_rollup(
        _items(spark, sf, _CHECKS), high_contrast=True, large_text=True)


@query("accessibility_failed_items", f"""with {_CHECKS}
select checklist, name from items where status = 'Fail'""")
def accessibility_failed_items(spark, sf):
    return checklists.items_with_status(_items(spark, sf, _CHECKS), "Fail")


@query("checklist_overrides", f"""with {_CHECKS}, o as (select 'A-' || (c_custkey * 7) as item_id,
  case when c_custkey % 5 = 0 then 'Unknown' else 'Pass' end as status, c_name as notes from customer)
select i.checklist, i.item_id, i.name, coalesce(o.status, i.status) as status, coalesce(o.notes, i.notes) as notes
from items i left join (select * from o where status <> 'Unknown') o on o.item_id = i.item_id""")
def checklist_overrides(spark, sf):
    overrides = table(spark, sf, "customer").select(
        F.concat(F.lit("A-"), F.col("c_custkey") * 7).alias("item_id"),
        F.when(F.col("c_custkey") % 5 == 0, "Unknown").otherwise("Pass").alias("status"),
        F.col("c_name").alias("notes"))
    return checklists.apply_status_overrides(_items(spark, sf, _CHECKS), overrides)


def _flag(check, statuses="('Met')"):
    return f"coalesce(bool_or(item_id = '{check}' and status in {statuses}), false)"


@query("deployment_flags", f"""with {_ITEMS}
select checklist, {_flag('DEPLOY-002', "('Met', 'Partially Met')")} as "AZURE_READY_ARTIFACTS_PRESENT",
  {_flag('DEPLOY-009')} as "AZURE_SMOKE_TEST_PASSED", {_flag('DEPLOY-003')} as "REQUIRE_LOCAL_OCR",
  not {_flag('DEPLOY-004')} as "ALLOW_EXTERNAL_ML_ENDPOINTS", not {_flag('DEPLOY-005')} as "COLA_INTEGRATION_ENABLED",
  not {_flag('DEPLOY-006')} as "ENABLE_UPLOAD_PERSISTENCE", not {_flag('DEPLOY-007')} as "ENABLE_RAW_TEXT_LOGGING",
  {_flag('DEPLOY-006')} as "LONG_TERM_STORAGE_DISABLED" from items group by checklist""")
def deployment_flags(spark, sf):
    return checklists.deployment_flags(_items(spark, sf, _ITEMS))


# --- Markdown reports as keyed lines, and the package of outputs --------------------------------

def _lines_sql(source, keys, section, position, lines):
    """DuckDB SQL for one block of report lines per row of a table."""
    listed = ", ".join(lines)
    return (f"select {keys}{section}::int as section, {position} as position, (unnest(range(0, {len(lines)})))::int as ordinal, "
            f"unnest([{listed}]) as line from {source}")


def _item_sql(fields):
    return _lines_sql("items", "checklist, ", 1, "item_id", [
        "'### ' || item_id || ' - ' || name", "''", *[f"'- {label}: ' || {value}" for label, value in fields], "''"])


def _half_up(x, digits=3):
    """Fixed digits, ties away from zero by the decimal value, as Spark formats numbers."""
    return f"cast(round(cast({x} as decimal(28, 9)), {digits}) as decimal(28, {digits}))::varchar"


@query("timing_markdown", _stats(True) + ", a as (select *, average <= 5 and p95 <= 5 and breaches = 0 as met from st) " + _lines_sql(
    "a", "batch_id, ", 0, "''", [
        "'# Performance Summary'", "''", "'Total Files: ' || total_files", *[
            f"'{label}: ' || {_half_up(name)}" for label, name in (
                ("Average Seconds", "average"), ("Median Seconds", "p50"), ("P95 Seconds", "p95"), ("Maximum Seconds", "top"))],
        "'SLA Seconds: 5.000'", "'SLA Breach Count: ' || breaches",
        "'SLA Breach Rate: ' || " + _half_up('breaches / total_files', 4) + "", "''", "'## Acceptance'", "''",
        "'Status: ' || case when met then 'Met' else 'Not Met' end",
        "'Meets Acceptance: ' || case when met then 'True' else 'False' end",
        "'Message: ' || case when met then 'Performance acceptance met for ' || total_files || ' timed label files. Average ' || "
        "" + _half_up('average') + " || 's and p95 ' || " + _half_up('p95') + " || 's were within configured targets.' else "
        "'Performance acceptance not met for ' || total_files || ' timed label files. Average ' || " + _half_up('average') + " || "
        "'s target 5.000s; p95 ' || " + _half_up('p95') + " || 's target 5.000s; breach rate ' || "
        "" + _half_up('breaches / total_files', 4) + " || ' target 0.0000.' end", "''"]))
def timing_markdown(spark, sf):
    accepted = performance.timing_acceptance(performance.timing_summary(_timings(spark, sf), by=("batch_id",)))
    return markdown.timing_markdown(accepted, ("batch_id",))


_DEPLOYMENT_HEAD = _lines_sql("""(select checklist, count(*) filter (status = 'Met') as met,
  count(*) filter (status = 'Partially Met') as partly, count(*) filter (status = 'Not Met') as failed,
  count(*) filter (status = 'Not Evaluated') as open from items group by checklist)""", "checklist, ", 0, "''", [
    "'# Deployment Evidence'", "''", "'Created On: 2024-01-01'",
    "'Overall Status: ' || case when failed > 0 then 'Not Met' when partly + open > 0 then 'Partially Met' else 'Met' end", "''",
    "'## Status Counts'", "''", "'- Met: ' || met", "'- Partially Met: ' || partly", "'- Not Met: ' || failed",
    "'- Not Evaluated: ' || open", "''", "'## Evidence Checks'", "''"])
_UNIQUE = "items as (select checklist, item_id || '-' || name as item_id, name, status from (with {0} select * from items))"


@query("deployment_markdown", f"with {_UNIQUE.format(_ITEMS)} {_DEPLOYMENT_HEAD} union all " + _item_sql((
    ("Category", "''"), ("Status", "status"), ("Evidence", "''"), ("Recommendation", "''"), ("Path", "''"), ("Evaluated On", "''"))))
def deployment_markdown(spark, sf):
    items = _items(spark, sf, _ITEMS).withColumn("item_id", F.concat_ws("-", "item_id", "name"))
    return markdown.deployment_markdown(items, "2024-01-01")


_ACCESS_HEAD = _lines_sql("""(select checklist, count(*) filter (status = 'Pass') as passed, count(*) filter (status = 'Fail') as failed,
  count(*) filter (status = 'Not Tested') as untested, count(*) filter (status = 'Not Applicable') as other
  from items group by checklist)""", "checklist, ", 0, "''", [
    "'# Accessibility Checklist'", "''", "'Created On: 2024-01-01'",
    "'Accessibility Status: ' || case when failed > 0 then 'Not Met' when untested > 0 then 'Partially Met' else 'Met' end",
    "'Message: ' || case when failed > 0 then failed || ' accessibility checklist item(s) failed and require remediation before acceptance.' "
    "when untested > 0 then untested || ' accessibility checklist item(s) remain untested. Manual browser validation is required.' "
    "else 'All applicable accessibility checklist items passed.' end", "''", "'## Summary'", "''",
    "'- High Contrast Available: True'", "'- Large Text Available: True'", "'- Keyboard Check Required: True'",
    "'- Passed Items: ' || passed", "'- Failed Items: ' || failed", "'- Untested Items: ' || untested",
    "'- Not Applicable Items: ' || other", "''", "'## Checklist Items'", "''"])


@query("accessibility_markdown", f"with {_CHECKS} {_ACCESS_HEAD} union all " + _item_sql((
    ("Category", "''"), ("Status", "status"), ("Procedure", "''"), ("Expected Result", "''"), ("Notes", "notes"), ("Evaluated On", "''"))))
def accessibility_markdown(spark, sf):
    return markdown.accessibility_markdown(_items(spark, sf, _CHECKS), "2024-01-01", high_contrast=True, large_text=True)


@query("acceptance_markdown")
def acceptance_markdown(spark, sf):
    """The lines of the requirement report; evidence_requirements and evidence_rollup compare its values."""
    rows = _requirements(spark, sf)
    return markdown.acceptance_markdown(rows, evidence.requirement_rollup(rows), "2024-01-01")


@query("package_index", f"""with d as (with {_ITEMS} select * from items), a as (with {_CHECKS} select * from items)
select output, format, written, records::bigint as records from (values
  ('accessibility', 'csv', true, (select count(*) from a)), ('accessibility', 'json', true, (select count(*) from a)),
  ('accessibility', 'markdown', true, (select 18 * count(distinct checklist) + 9 * count(*) from a)),
  ('deployment', 'csv', true, (select count(*) from d)), ('deployment', 'json', true, (select count(*) from d)),
  ('deployment', 'markdown', true, (select 14 * count(distinct checklist) + 9 * count(*) from d)),
  ('performance', 'csv', true, (select count(*) from events)), ('nothing', 'csv', false, 0),
  ('package_manifest', 'json', true, 8)) as t(output, format, written, records)""")
def package_index(spark, sf):
    """What a written package holds: the index, and how many records each output reads back as."""
    access, deploy = _items(spark, sf, _CHECKS), _items(spark, sf, _ITEMS)
    folder = scratch(spark)
    index = write_outputs(
        {"accessibility": access, "deployment": deploy, "performance": performance.performance_table(_timings(spark, sf)),
         "nothing": deploy.where("false")},
        {"accessibility": markdown.accessibility_markdown(access, "2024-01-01"),
         "deployment": markdown.deployment_markdown(deploy, "2024-01-01")}, folder, as_json=("accessibility", "deployment"))
    found = None
    for name, kind in (("accessibility", "csv"), ("accessibility", "json"), ("accessibility", "md"), ("deployment", "csv"),
                       ("deployment", "json"), ("deployment", "md"), ("performance", "csv")):
        path = f"{folder}/{name}_redacted_{kind}"
        read = spark.read.csv(path, header=True, escape='"') if kind == "csv" else spark.read.text(path)
        counted = read.agg(F.count(F.lit(1)).alias("records")).select(
            F.lit(name).alias("output"), F.lit("markdown" if kind == "md" else kind).alias("format"), "records")
        found = counted if found is None else found.unionAll(counted)
    listed = spark.read.json(f"{folder}/package_manifest_json").agg(F.count(F.lit(1)).alias("records")).select(
        F.lit("package_manifest").alias("output"), F.lit("json").alias("format"), F.lit(True).alias("written"), "records")
    return index.drop("path").join(found, ["output", "format"], "left").select(
        "output", "format", "written", F.coalesce("records", F.lit(0)).alias("records")).unionAll(listed)


# --- archives: all pages, packed by fifties, some under names that must not be unpacked --------

_PAGE_MEMBER = """case page_id % 10 when 0 then '../' when 1 then '__MACOSX/' when 2 then 'a/.' when 3 then 'b/c/'
  when 4 then '/' else '' end || 'page_' || cast(page_id as string) || case page_id % 10 when 5 then '.txt' when 6 then '.PDF'
  else '.png' end"""
_UNPACKED = "page_id % 10 not in (0, 1, 2, 4, 5)"


def _page_archives(spark, sf):
    """ZIP values of fifty pages each; every second archive is stored, the others are deflated."""
    pages = table(spark, sf, "pages").select(
        F.floor(F.col("page_id") / 50).alias("part"), F.expr(_PAGE_MEMBER).alias("member"), F.col("html").alias("body"))

    def pack(rows):
        import io
        import zipfile

        import pandas as pd

        part, whole = int(rows["part"].iloc[0]), io.BytesIO()
        kind = zipfile.ZIP_STORED if part % 2 else zipfile.ZIP_DEFLATED
        with zipfile.ZipFile(whole, "w", kind) as archive:
            for member, body in sorted(zip(rows["member"], rows["body"])):
                archive.writestr(member, body or "")
        return pd.DataFrame({"path": [f"/uploads/pages_{part}.zip"], "content": [whole.getvalue()]})

    return pages.groupBy("part").applyInPandas(pack, "path string, content binary")


@query("archive_contents", f"""
select 'pages_' || cast(page_id // 50 as string) || '.zip' as source, {_PAGE_MEMBER} as member,
  octet_length(encode(coalesce(html, ''))) as size, greatest(1, (octet_length(encode(coalesce(html, ''))) + 999) // 1000) as chunks,
  md5(coalesce(html, '')) as digest from pages where {_UNPACKED}""")
def archive_contents(spark, sf):
    """Every page comes out of its archive whole, in chunks of at most a thousand bytes."""
    chunks = artwork.member_chunks(artwork.list_members(_page_archives(spark, sf)), 1000).where("error is null")
    # The bytes of a page, put together again by their numbers.
    ordered = F.array_sort(F.collect_list(F.struct("chunk", F.hex("content").alias("hex"))))
    return chunks.groupBy("source", "member", "size").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.md5(F.unhex(F.array_join(F.transform(ordered, lambda c: c["hex"]), ""))).alias("digest"))


@query("archive_inventory", f"""
select 'pages_' || cast(page_id // 50 as string) || '.zip' as "Source", 'page_' || page_id || case page_id % 10 when 6 then '.PDF'
  else '.png' end as "File Name", round(octet_length(encode(coalesce(html, ''))) / 1024.0, 2)::double as "Size KB",
  case page_id % 10 when 6 then 'pdf' else 'png' end as "Type", 'ZIP Member' as "Input Type" from pages where {_UNPACKED}""")
def archive_inventory(spark, sf):
    """The inventory of the same archives, read without unpacking a member."""
    members = artwork.expand_archives(_page_archives(spark, sf), with_content=False)
    return artwork.inventory(members.where("false"), members)
