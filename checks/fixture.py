"""Label and manifest rows derived from the given tables, as SQL both engines run.

Every ``part`` row becomes one label. Its key picks one of eight scenarios (clean, fuzzy brand,
ABV mismatch, missing warning, two image-only ones, import, missing net contents), one of eight
wording variants, one of two ABV wordings and one of sixteen further differences (no brand, another
brand on the label, no proof, a wrong proof, other net contents, no producer, no importer, no class,
another class, no net contents expected), so that every rule outcome occurs at sf0.01. ``nation`` has a fixed
25 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.constants import WARNING_TEXT
from attestra.sources.spread import spread
from checks.registry import table

_WARNING_SQL = WARNING_TEXT.replace("'", "''")

KEYED = """
select p_partkey as k,
       p_partkey % 8 + 1 as scenario,
       cast(floor(p_partkey / 8) as bigint) % 8 as variant,
       cast(floor(p_partkey / 64) as bigint) % 2 as wording,
       cast(floor(p_partkey / 128) as bigint) % 16 as extra,
       upper(p_name) as root,
       p_type || case when p_partkey % 8 + 1 = 7 then ' Irish Whiskey'
                      else ' Bourbon Whiskey' end as class_text,
       cast(40.0 + p_partkey % 8 + (p_partkey % 4) * 0.5 as double) as base_abv,
       case when n_nationkey % 2 = 0 then 'Ireland' else n_name end as country
from part join nation on n_nationkey = p_partkey % 25
"""

FIXTURE = f"""
with keyed as ({KEYED}),
expected as (
  select *,
         'label_' || lpad(cast(k as string), 9, '0') || '.png' as file_name,
         case when extra = 1 then '' else
           root || case when scenario = 2 then '''S DISTILLING' else ' DISTILLING' end end as brand_name,
         case when extra = 8 then '' else class_text end as class_type,
         case when variant = 6 then 'Wine' else 'Distilled Spirits' end as beverage_type,
         case when variant = 4 then cast(0 as double) else base_abv end as alcohol_content,
         case when extra = 12 then '' when variant = 5 then '12 fl. oz.' when scenario = 7 then '700 mL'
              else '750 mL' end as net_contents,
         root || ' Beverage Company LLC, Washington, DC' as producer_bottler,
         (scenario = 7 or variant = 7) as imported
  from keyed
),
lines as (
  select *,
         case when extra = 2 then 'HARBOR LIGHT CELLARS' else
           root || case when scenario = 2 then 'S DISTILLING' else ' DISTILLING' end end as l_brand,
         case when extra = 9 then 'Cherry Liqueur' else class_text end as l_class,
         case when variant = 4 then cast(0 as double) when scenario = 3 then greatest(35.0, alcohol_content - 5.0)
              else alcohol_content end as l_abv,
         case when scenario = 4 then ''
              when variant = 1 then replace('{_WARNING_SQL}', 'GOVERNMENT WARNING', 'Government Warning')
              when variant = 2 then replace('{_WARNING_SQL}', 'Surgeon', 'Surgical')
              else '{_WARNING_SQL}' end as l_warning,
         case when scenario = 8 then '' when extra = 5 then chr(10) || 'NET CONTENTS: 1.75 L'
              when extra = 12 then chr(10) || 'NET CONTENTS: 750 mL'
              else chr(10) || 'NET CONTENTS: ' || net_contents end as l_net,
         case when imported then case when extra = 7 then '' else
              chr(10) || 'IMPORTED BY Harbor Imports LLC, Washington, DC' end ||
              chr(10) || case when variant = 7 then 'PRODUCT OF ' else 'COUNTRY OF ORIGIN: ' end ||
              country else '' end as l_import
  from expected
),
abv as (
  select *, replace(cast(l_abv as string), '.0', '') as abv_text,
         replace(cast(2 * l_abv + case when extra = 4 then 10 else 0 end as string), '.0', '') as proof_text
  from lines
)
select k as row_id, scenario, variant, wording, file_name, brand_name, class_type, beverage_type,
       alcohol_content, 2 * alcohol_content as proof, net_contents, producer_bottler, imported,
       case when imported then 'Harbor Imports LLC' else '' end as importer,
       case when imported then country else '' end as country_of_origin,
       'C-' || cast(k as string) as cola_id,
       'scenario ' || cast(scenario as string) as notes,
       case when variant = 3 then '' else
         l_brand || chr(10) || l_class || chr(10) ||
         case when wording = 1 then 'ALC. ' || abv_text || '% BY VOL' else abv_text || '% ALC/VOL' end ||
         case when extra = 3 then '' else ' / ' || proof_text || ' PROOF' end || l_net || chr(10) ||
         case when extra = 6 then '' else 'BOTTLED BY ' || producer_bottler end || l_import ||
         case when l_warning = '' then '' else chr(10) || l_warning end
       end as raw_text,
       case when scenario = 5 then 'Image may have low contrast.'
            when scenario = 6 then 'Image may be skewed by approximately 3.0 degrees.'
            else '' end as quality_note,
       cast((k % 13) * 0.6 as double) as ocr_seconds
from abv
"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application values and label text, one row per label."""
    # The {part} and {nation} slots take frames; braces occur nowhere else in the text.
    query = FIXTURE.replace("from part join nation", "from {part} join {nation}")
    rows = spark.sql(query, part=spread(table(spark, sf_dir, "part"), "p_partkey"),
                     nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    note = F.col("quality_note")
    empty = F.array().cast("array<string>")
    return rows.withColumn(
        "image_quality_notes", F.when(note == "", empty).otherwise(F.array(note)))
