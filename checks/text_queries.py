"""Normalization, parsing and extraction over documents, conversations, pages and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.constants import (
    CLASS_KEYWORDS, EXTRACT_ABV_PATTERNS, EXTRACT_COUNTRY_PHRASES, EXTRACT_NET_PATTERN,
    EXTRACT_PRODUCER_PHRASES, EXTRACT_WARNING_PATTERN, NOT_BRAND_PHRASES, WARNING_TEXT,
)
from attestra.functions import extract, fuzzy, sanitize
from attestra.functions import text as tx
from attestra.operators import needles
from attestra.operators.matching import name_key
from checks.fixture import FIXTURE, labels
from checks.registry import documents, query, table


def spaced(x):
    """SQL for collapsing white space, Unicode spaces included."""
    return rf"trim(regexp_replace({x}, '[\s\x0b\x1c-\x1f\x85\xA0\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{3000}}]+', ' ', 'g'))"


def folded(x):
    return rf"regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')"


def normal(x):
    return spaced(f"lower(replace({folded(x)}, '`', ''''))")


def match(x):
    return f"trim(regexp_replace(lower({folded(x)}), '[^a-z0-9]+', ' ', 'g'))"


def replaced(x, pairs):
    for old, new in pairs:
        x = f"replace({x}, '{old}', '{new}')"
    return x


@query("normalize_documents", f"""
select doc_id, {folded('text')} as folded, {normal('text')} as normalized,
       {match('text')} as match_form from documents""")
def normalize_documents(spark, sf):
    docs = documents(spark, sf)
    text = docs.withColumn("folded", tx.fold_ascii(F.col("text"), pinned=True))
    return text.select(
        "doc_id", "folded", tx.normalize_folded(F.col("folded")).alias("normalized"),
        tx.match_folded(F.col("folded")).alias("match_form"))


@query("normalize_conversations", rf"""
select conv_id, turn, {spaced('text')} as spaced,
       {spaced("regexp_replace(replace(text, '|', ' '), '[_~^]+', ' ', 'g')")} as cleaned,
       {normal("regexp_replace(replace(text, '|', ' '), '[_~^]+', ' ', 'g')")} as label_form,
       replace(text, '`', '''') as apostrophes
from conversations""")
def normalize_conversations(spark, sf):
    text = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.collapse_spaces(text).alias("spaced"),
        tx.clean_artifacts(text).alias("cleaned"),
        tx.normalize_label_text(text).alias("label_form"),
        tx.fold_apostrophes(text).alias("apostrophes"))


_NET_TEXTS = """case p_partkey % 10 when 0 then ' Milliliters' when 1 then ' milliliter'
    when 2 then ' m.l.' when 3 then 'ML.' when 4 then ' Liters' when 5 then ' liter'
    when 6 then ' fluid ounces' when 7 then ' Fluid  Ounce' when 8 then ' fl. oz.'
    else ' fl oz.' end"""
_ABV_TEXTS = """case p_partkey % 6 when 0 then ' ALC./VOL.' when 1 then '% alc/vol'
    when 2 then '% Alc  Vol' when 3 then ' Alcohol by Volume' when 4 then ' alcohol/volume'
    else ' proof' end"""
_NET_PAIRS = (
    ("milliliters", "ml"), ("milliliter", "ml"), ("m.l.", "ml"), ("ml.", "ml"), ("liters", "l"),
    ("liter", "l"), ("fluid ounces", "fl oz"), ("fluid ounce", "fl oz"), ("fl. oz.", "fl oz"),
    ("fl oz.", "fl oz"))
_ABV_PAIRS = (("alc./vol.", "abv"), ("alc/vol", "abv"), ("alc vol", "abv"),
              ("alcohol by volume", "abv"), ("alcohol/volume", "abv"))


@query("normalize_units", f"""
with t as (select p_partkey, p_size::varchar || {_NET_TEXTS} as net,
                  p_size::varchar || {_ABV_TEXTS} as abv from part)
select p_partkey, {spaced(replaced(normal('net'), _NET_PAIRS))} as net_contents,
       {spaced(replaced(normal('abv'), _ABV_PAIRS))} as alcohol from t""")
def normalize_units(spark, sf):
    size = F.col("p_size").cast("string")
    return table(spark, sf, "part").select(
        "p_partkey",
        tx.normalize_net_contents(F.concat(size, F.expr(_NET_TEXTS))).alias("net_contents"),
        tx.normalize_abv_text(F.concat(size, F.expr(_ABV_TEXTS))).alias("alcohol"))


@query("parse_numbers", r"""
with t as (
  select o_orderkey, case when o_orderkey % 3 = 0 then 'USD ' || (o_orderkey % 1000)::varchar
                               || '.' || (o_orderkey % 97)::varchar || '.5'
                          when o_orderkey % 3 = 1 then o_orderpriority
                          else (o_orderkey % 101)::varchar || ' % ' end as raw
  from orders),
n as (select *, regexp_replace(raw, '[^0-9.]', '', 'g') as kept from t)
select o_orderkey,
       case when contains(kept, '.') then split_part(kept, '.', 1) || '.' ||
            replace(substr(kept, instr(kept, '.') + 1), '.', '') else kept end as numeric_text,
       try_cast(case when contains(kept, '.') then split_part(kept, '.', 1) || '.' ||
            replace(substr(kept, instr(kept, '.') + 1), '.', '') else kept end as double) as number,
       try_cast(trim(replace(raw, '%', '')) as double) as form_number
from n""")
def parse_numbers(spark, sf):
    raw = F.expr("""case when o_orderkey % 3 = 0 then 'USD ' || cast(o_orderkey % 1000 as string)
        || '.' || cast(o_orderkey % 97 as string) || '.5'
        when o_orderkey % 3 = 1 then o_orderpriority
        else cast(o_orderkey % 101 as string) || ' % ' end""")
    orders = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    return orders.select(
        "o_orderkey", tx.numeric_string(F.col("raw")).alias("numeric_text"),
        tx.parse_float(F.col("raw")).alias("number"),
        tx.parse_optional_float(F.col("raw")).alias("form_number"))


@query("proof_tolerance", """
with t as (select l_orderkey, l_linenumber, l_quantity as abv,
                  2 * l_quantity + (l_orderkey % 5) * 0.25 - 0.5 as proof, l_discount from lineitem)
select l_orderkey, l_linenumber, nullif(l_discount, 0) as discount_value,
       nullif(abv, 0) * 2 as proof_from_abv,
       coalesce(abv <> 0 and proof <> 0 and abs(2 * abv - proof) <= 0.75, false) as consistent,
       format('{:g}', proof) || ' Proof' as label
from t""")
def proof_tolerance(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", F.col("l_quantity").alias("abv"),
        (2 * F.col("l_quantity") + (F.col("l_orderkey") % 5) * 0.25 - 0.5).alias("proof"))
    wanted = tx.proof_from_abv(F.col("abv"))
    return rows.select(
        "l_orderkey", "l_linenumber",
        tx.number_or_null(F.col("l_discount")).alias("discount_value"),
        wanted.alias("proof_from_abv"),
        tx.values_close(wanted, F.col("proof"), 0.75).alias("consistent"),
        F.concat(tx.format_g(F.col("proof")), F.lit(" Proof")).alias("label"))


@query("page_base_names", r"""
select page_id, regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) as base_name,
       lower(trim(url)) as name_key from pages""")
def page_base_names(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", tx.base_name(F.col("url")).alias("base_name"),
        name_key(F.col("url")).alias("name_key"))


@query("contains_phrase_labels", f"""
with fx as ({FIXTURE})
select file_name, raw_text <> '' and brand_name <> '' and contains({match('raw_text')}, {match('brand_name')}) as brand_found,
       raw_text <> '' and class_type <> '' and contains({match('raw_text')}, {match('class_type')}) as class_found,
       regexp_matches(raw_text, '\\bGOVERNMENT\\s+WARNING\\s*:') as caps_prefix
from fx""")
def contains_phrase_labels(spark, sf):
    text = F.col("raw_text")
    return labels(spark, sf).select(
        "file_name", tx.contains_phrase(text, F.col("brand_name")).alias("brand_found"),
        tx.contains_phrase(text, F.col("class_type")).alias("class_found"),
        tx.has_caps_prefix(text).alias("caps_prefix"))


def _needles_sql(needles):
    return f"""
with d as (select doc_id, {match('text')} as t from documents where text <> ''),
n as (select needle_id, {match('phrase')} as p from ({needles}) where phrase <> '')
select doc_id, needle_id, case when p = '' then 1 else instr(t, p)::int end as at
from d join n on contains(t, p)"""


@query("contains_needles", _needles_sql("select item_id as needle_id, text as phrase from benchmark"))
def contains_needles(spark, sf):
    """All documents against all benchmark passages."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("phrase"))
    return needles.find_needles(documents(spark, sf), items, "doc_id", "text", "needle_id", "phrase")


@query("contains_needles_short", _needles_sql("""
  select item_id * 10 + k as needle_id, array_to_string(string_split(text, ' ')[:k], ' ') as phrase
  from benchmark, (select unnest([1, 2, 3]) as k)
  union all select -1, '--' union all select -2, null"""))
def contains_needles_short(spark, sf):
    """The first one, two and three words of each passage, a phrase of marks, and none."""
    words = F.split("text", " ")
    items = table(spark, sf, "benchmark").select(F.explode(F.array(*[F.struct(
        (F.col("item_id") * 10 + k).alias("needle_id"), F.array_join(F.slice(words, 1, k), " ").alias("phrase"))
        for k in (1, 2, 3)])).alias("n")).select("n.*")
    odd = spark.createDataFrame([(-1, "--"), (-2, None)], items.schema)
    return needles.find_needles(
        documents(spark, sf), items.unionAll(odd), "doc_id", "text", "needle_id", "phrase")


def context_sql(text, phrase, window=80):
    at = f"instr({text}, {phrase})"
    return (f"case when {phrase} = '' or {at} = 0 then '' else trim(substr({text}, greatest({at} - {window}, 1), "
            f"least(length({text}), {at} - 1 + length({phrase}) + {window}) "
            f"- greatest({at} - 1 - {window}, 0))) end")


@query("context_labels", f"""
with fx as ({FIXTURE}), n as (
  select file_name, raw_text, {normal('raw_text')} as t, {normal('class_type')} as p,
         {normal('brand_name')} as b from fx)
select file_name, case when raw_text = '' then '' else {context_sql('t', 'p')} end as class_context,
       case when raw_text = '' then '' else {context_sql('t', 'b', 20)} end as brand_context
from n""")
def context_labels(spark, sf):
    return labels(spark, sf).select(
        "file_name",
        tx.extract_context(F.col("raw_text"), F.col("class_type")).alias("class_context"),
        tx.extract_context(F.col("raw_text"), F.col("brand_name"), 20).alias("brand_context"))


_LINES = (r"list_filter(list_transform(regexp_split_to_array({x}, '[\n\x0b\x0c\r\x1c-\x1e]|\x{{85}}|\x{{2028}}|\x{{2029}}'), "
          r"lambda v: " + spaced("v").replace("{", "{{").replace("}", "}}") + r"), lambda v: v <> '')")


def lines_sql(x):
    return _LINES.format(x=x)


def first_line(condition):
    return f"coalesce(list_filter(l, lambda v: {condition})[1], '')"


def any_of(words, value):
    return "(" + " or ".join(f"contains(upper({value}), '{w}')" for w in words) + ")"


_COUNTRY = "(?i)(?:" + "|".join(EXTRACT_COUNTRY_PHRASES) + r")\s*:?\s*(.+)"
EXTRACT_SELECT = rf"""
  {first_line("length(v) >= 3 and not " + any_of(NOT_BRAND_PHRASES, 'v'))} as brand_name,
  {first_line(any_of(CLASS_KEYWORDS, 'v'))} as class_type,
  coalesce(try_cast(nullif(regexp_extract(t, '{EXTRACT_ABV_PATTERNS[0]}', 1, 'i'), '') as double),
           try_cast(nullif(regexp_extract(t, '{EXTRACT_ABV_PATTERNS[1]}', 1, 'i'), '') as double),
           try_cast(nullif(regexp_extract(t, '{EXTRACT_ABV_PATTERNS[2]}', 1, 'i'), '') as double))
    as alcohol_content,
  case when regexp_extract(t, '{EXTRACT_NET_PATTERN}', 1, 'i') = '' then '' else
    regexp_extract(t, '{EXTRACT_NET_PATTERN}', 1, 'i') || ' ' ||
    {spaced(f"regexp_extract(t, '{EXTRACT_NET_PATTERN}', 2, 'i')")} end as net_contents,
  {first_line(any_of(EXTRACT_PRODUCER_PHRASES, 'v'))} as producer_bottler,
  coalesce(trim(regexp_extract(list_filter(l, lambda v: regexp_matches(v, '{_COUNTRY}'))[1],
           '{_COUNTRY}', 1)), '') as country_of_origin,
  case when contains(upper({spaced('t')}), upper('{WARNING_TEXT}')) then '{WARNING_TEXT}'
       else trim(regexp_extract({spaced('t')}, '{EXTRACT_WARNING_PATTERN}', 1, 'i')) end
    as government_warning"""


def _extracted(df, key, text):
    cleaned = df.select(key, F.col(text).alias("t"),
                        extract.clean_lines(F.col(text)).alias("lines"))
    return cleaned.select(
        key, extract.extracted_fields(F.col("t"), F.col("lines")).alias("e")).select(key, "e.*")


@query("extract_fields", f"""
with fx as ({FIXTURE}), b as (select file_name, raw_text as t, {lines_sql('raw_text')} as l from fx)
select file_name, {EXTRACT_SELECT} from b""")
def extract_fields(spark, sf):
    return _extracted(labels(spark, sf), "file_name", "raw_text")


@query("extract_documents", f"""
with b as (select doc_id, text as t, {lines_sql('text')} as l from documents)
select doc_id, {EXTRACT_SELECT} from b""")
def extract_documents(spark, sf):
    return _extracted(documents(spark, sf), "doc_id", "text")


@query("extract_lines", f"""
with b as (select conv_id, turn, {lines_sql('text')} as l from conversations)
select conv_id, turn, unnest(l) as line, unnest(range(len(l))) as ordinal from b""")
def extract_lines(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("l", extract.lines(F.col("text")))
    return rows.select("conv_id", "turn", F.posexplode("l").alias("ordinal", "line"))


@query("extracted_field_map", f"""
with fx as ({FIXTURE}), b as (select file_name, raw_text as t, {lines_sql('raw_text')} as l from fx),
e as (select file_name, {EXTRACT_SELECT} from b)
select file_name, unnest(['Brand Name', 'Class / Type', 'Alcohol Content', 'ABV', 'Net Contents',
    'Producer / Bottler', 'Country of Origin', 'Government Warning']) as field,
  unnest([brand_name, class_type, alcohol_content::varchar, alcohol_content::varchar, net_contents,
    producer_bottler, country_of_origin, government_warning]) as value from e""")
def extracted_field_map(spark, sf):
    rows = labels(spark, sf).withColumn("lines", extract.clean_lines(F.col("raw_text")))
    fields = rows.withColumn(
        "e", extract.extracted_fields(F.col("raw_text"), F.col("lines")))
    return fields.select("file_name", F.explode(extract.field_map(F.col("e")))
                         .alias("field", "value"))


# Letters of one string as bit masks over the other, folded by the bit-parallel LCS step.
def lcs_sql(needle, masks):
    full = f"((1::bigint << length({needle})) - 1)"
    step = f"(((s + (s & x)) | (s - (s & x))) & {full})"
    return (f"(length({needle}) - bit_count(list_reduce({masks}, lambda s, x: {step}, {full})))")


def masks_sql(needle, text):
    bit = f"case when substr({needle}, i + 1, 1) = c then 1::bigint << i else 0::bigint end"
    return (f"list_transform(string_split({text}, ''), lambda c: "
            f"list_sum(list_transform(range(length({needle})), lambda i: {bit}))::bigint)")


def partial_ratio_sql(source, key, needle, text):
    """Best window score per row of ``source``, for needles of at most 62 characters that are
    shorter than the text."""
    return f"""
  with masked as materialized (
    select {key}, {needle} as n, {masks_sql(needle, text)} as m from {source}),
  windows as (
    select {key}, n, m, unnest(range(2 - length(n), len(m) + 1)) as i from masked),
  cut as (
    select {key}, n, list_slice(m, greatest(i, 1), least(len(m), i + length(n) - 1)) as w
    from windows)
  select {key}, max(200.0 * {lcs_sql('n', 'w')} / (length(n) + len(w))) as score
  from cut group by {key}"""


@query("fuzzy_ratio_parts", f"""
with t as (select p_partkey, p_name as a, lower(p_type) || ' ' || lower(p_brand) as b from part)
select p_partkey, round(200.0 * {lcs_sql('a', masks_sql('a', 'b'))} / (length(a) + length(b)), 6) as score
from t""")
def fuzzy_ratio_parts(spark, sf):
    other = F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand"))
    return table(spark, sf, "part").select(
        "p_partkey", F.round(fuzzy.ratio(F.col("p_name"), other), 6).alias("score"))


@query("fuzzy_partial_parts", f"""
with t as (select p_partkey, p_name as a, lower(p_type) || ' ' || lower(p_brand) || ' ' ||
                  reverse(p_name) as b from part)
select p_partkey, round(score, 6) as score from ({partial_ratio_sql('t', 'p_partkey', 'a', 'b')})""")
def fuzzy_partial_parts(spark, sf):
    other = F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand"), F.reverse("p_name"))
    return table(spark, sf, "part").select(
        "p_partkey", F.round(fuzzy.partial_ratio(F.col("p_name"), other), 6).alias("score"))


_JUNK = """case {k} % 8
  when 0 then ' see C:\\Users\\me\\labels\\a.png now' when 1 then ' /tmp/run/x.txt, and /home/u/y'
  when 2 then ' mail Jane.Doe@Example.org today'
  when 3 then ' id 123e4567-e89b-12d3-a456-426614174000'
  when 4 then ' api_key = abc123; token:xyz' when 5 then ' \\temp\\x.log'
  when 6 then ' "' || repeat('q', 130) || '"' else ' a, b, c, d, e, f' end"""
_SQL_STEPS = (
    (r"[\r\n\t]+", " "), (r"\s{2,}", " "), None,
    (r'[A-Za-z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]*', "[PATH]"),
    (r"/(?:tmp|mnt|var|home|Users|user|workspace|app|data)(?:/[^\s,;:)]*)+", "[PATH]"),
    (r"(?i)\\(?:tmp|temp|users|appdata|programdata)\\[^\s,;:)]*", "[PATH]"),
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[EMAIL]"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "[GUID]"),
    (r"(?i)(password|secret|token|api[_-]?key|subscription[_-]?key)\s*[=:]\s*[^\s,;]+",
     r"\1=[SECRET]"),
    (r'"[^"]{120,}"', '"[LONG_TEXT]"'), (r"'[^']{120,}'", "'[LONG_TEXT]'"))


def sanitize_sql(x, limit=1000):
    for step in _SQL_STEPS:
        if step is None:
            x = f"trim({x})"
        else:
            pattern, new = (v.replace("'", "''") for v in step)
            x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return (f"(select left(case when length(v) > 300 and length(v) - length(replace(v, ',', '')) >= 5 "
            f"then '[MANIFEST_ROW]' when length(v) > 500 and "
            f"len(regexp_extract_all(v, '\\b[A-Za-z]{{3,}}\\b')) > 60 then '[LONG_TEXT]' else v end, {limit}) "
            f"from (select {x} as v))")


# The oracle's word boundaries are ASCII, so both sides read the folded text.
@query("sanitize_conversations", f"""
with t as (select conv_id, turn, {folded('text')} || {_JUNK.format(k='(conv_id + turn)')} as x
           from conversations)
select conv_id, turn, {sanitize_sql('x')} as safe, {sanitize_sql('x', 120)} as short from t""")
def sanitize_conversations(spark, sf):
    junk = _JUNK.format(k="(conv_id + turn)").replace("\\", "\\\\")
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.concat(tx.fold_ascii(F.col("text"), pinned=True), F.expr(junk)).alias("x"))
    return rows.select(
        "conv_id", "turn", sanitize.sanitize_text(F.col("x")).alias("safe"),
        sanitize.sanitize_text(F.col("x"), 120).alias("short"))
