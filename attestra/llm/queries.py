"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import (
    byte_bpe, embedding_dedup, fingerprints, licenses, mixing, ngram_join, packing,
    prefix_trie, spelling, suffix_dedup, token_counts, toxicity, url_filters,
)
from attestra.llm.common import read, settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), word_vocabulary())


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"), mixing.word_count(F.col("text")))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(
        read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN)


#: Rules of the URL query: verdict, host, path prefix (fixed values).
URL_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: The listed URLs are the canonical ones of pages whose host has one of these as a part.
LISTED_HOST_PARTS = ("ads", "adult", "bets", "casino", "pills", "spam")


@query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    host, path = url_filters.url_host(F.col("url")), url_filters.url_path(F.col("url"))
    listed = pages.where(F.arrays_overlap(
        F.split(host, r"[.-]"), F.array(*map(F.lit, LISTED_HOST_PARTS)))).select(
        url_filters.canonical(host, path).alias("url")).distinct()
    return url_filters.judge_urls(pages, rules, listed)


_LISTED = "|".join(LISTED_HOST_PARTS)
SQL["op8_url_filters"] = f"""
with urls as (
  select page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') h,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path
  from pages),
parts as (
  select page_id, path, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host
  from urls),
canon as (
  select *, regexp_replace(host, '^www\\.|:(80|443)$', '', 'g')
            || regexp_replace(path, '(/index)?(\\.html?)?/*$', '') as url from parts),
listed as (
  select distinct url from canon where url <> '' and regexp_matches(host, '(^|[.-])({_LISTED})([.-]|$)')),
rules(verdict, rh, rp) as (values {', '.join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}),
fits as (
  select page_id, host, path, rh || rp as rule, verdict,
         row_number() over (partition by page_id, host, path order by length(rh || rp) desc) as k
  from parts join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select c.page_id, c.host, c.path, f.rule,
       coalesce(f.verdict, case when l.url is not null then 'block' else 'allow' end) as verdict,
       l.url is not null as listed
from canon c left join fits f on f.page_id = c.page_id and f.host = c.host and f.path = c.path and f.k = 1
left join listed l on l.url = c.url"""


@query
def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct("words.label"))
    every = F.array_sort(F.array_union(base, "spans.label"))
    least = F.array_min(F.transform("spans", lambda s: s["edits"].cast("double") / (F.length(s["found"]) + 1)))
    return found.select(
        "doc_id", "n_words", F.size("words").cast("long").alias("n_base"),
        F.array_min("words.word").alias("first_word"), F.array_max("words.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("words") > 0, F.lit(1.0)).when(F.size("spans") > 0, 1.0 - least)
        .otherwise(F.lit(0.0)).alias("score"), "spans")


@query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read(spark, sf_dir, "documents"))


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> tuple[list, list[str]]:
    """The fitted chain of the two labelled categories: junk (quality 0), then toxic."""
    categories = {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}
    return toxicity.train(docs, labels, categories), list(categories)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    chain, names = toxicity_chain(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain, names).withColumn("toxic", F.col("p_toxic") >= 0.5)


@query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


#: Bytes from which a repeated passage counts. 51 words of two letters on average with their spaces
#: are 152 bytes, so passages of over 50 words count in every language; ordinary phrases are shorter.
PASSAGE_BYTES = 150


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), passage=PASSAGE_BYTES)


@query
def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"))


SQL["op10_ngram_jaccard_join"] = r"""
with recursive words as (
  select doc_id, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') as w
  from documents),
grams as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as gram
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as shared
  from grams a join grams b on a.gram = b.gram and a.doc_id <> b.doc_id group by all),
links as (
  select x, y from pairs join sizes a on a.doc_id = x join sizes b on b.doc_id = y
  where shared * 1.8 >= 0.8 * (a.n + b.n) - 1e-9),
reach as (
  select doc_id as s, doc_id as t from words
  union select s, y from reach join links on t = x),
classes as (select s as doc_id, min(t) as class_id from reach group by s),
degrees as (select x as doc_id, count(*) as n_links from links group by x)
select doc_id, class_id, coalesce(n_links, 0) as n_links,
       case when len(w) = 0 then doc_id else min(doc_id) over (partition by text) end as copy_id,
       case when len(w) = 0 then 1 else count(*) over (partition by text) end as n_copies
from words join classes using (doc_id) left join degrees using (doc_id)"""


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = byte_bpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(tokens, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose first turns are those of the first conversation of their hundred."""
    paths = prefix_trie.turn_paths(read(spark, sf_dir, "conversations"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    first = (F.col("conv_id") - F.col("conv_id") % 100).alias("_first")
    heads = paths.where(F.col("conv_id") % 100 == 0).select(
        F.col("conv_id").alias("_first"), prefix_trie.first_turns(F.col("path"), F.lit(5)).alias("_head"))
    path = F.concat(prefix_trie.first_turns(F.coalesce("_head", F.lit(b"")), n),
                    prefix_trie.after_turns(F.col("path"), n))
    rebuilt = paths.withColumn("_first", first).join(heads, "_first", "left").select("conv_id", path.alias("path"))
    return prefix_trie.prefix_trie(rebuilt)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes, bit by bit."""
    hexed = f"hex(encode({text}))"
    return (
        f"xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(0, length({hexed}) // 2), "
        f"lambda k: [('0x' || {hexed}[2 * k + 1:2 * k + 2])::bigint, {', '.join(['0::bigint'] * 7)}]))), "
        "lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)")


SQL["op12_conversation_prefix_trie"] = f"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
  from conversations where conv_id is not null),
convs as (
  select conv_id, {crc32_sql("cast(conv_id as varchar)")} % 6 as h, conv_id - conv_id % 100 as base
  from (select distinct conv_id from turns)),
rebuilt as (
  select c.conv_id, 0 as part, t.i, t.role, t.text from convs c join turns t on t.conv_id = c.base and t.i <= c.h
  union all
  select c.conv_id, 1, t.i, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.i > c.h),
prefixes as (
  select conv_id, row_number() over w as depth, length(text) as chars,
         string_agg(length(role) || ':' || length(text) || ':' || role || text, '') over (
           partition by conv_id order by part, i rows unbounded preceding) as key
  from rebuilt window w as (partition by conv_id order by part, i)),
steps as (
  select conv_id, depth, chars, key from prefixes union all select conv_id, 0, 0, '' from convs),
members as (
  select *, lag(key) over (partition by conv_id order by depth) as above,
         depth = max(depth) over (partition by conv_id) as ends from steps),
nodes as (
  select key, depth, min(conv_id) as conv_id, min(above) as above, min(chars) as chars, count(*) as n_convs,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from members group by key, depth),
children as (select above as key, depth - 1 as depth, count(*) as n from nodes where depth > 0 group by all),
sums as (
  select m.key, m.depth, sum(case when c.n is null then 1 else 0 end) as n_leaves,
         sum((n.n_convs - 1) * n.chars) as saved_tokens
  from nodes n left join children c on c.key = n.key and c.depth = n.depth
  join members m on m.conv_id = n.conv_id and m.depth <= n.depth group by all)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children,
       cast(s.n_leaves as bigint) as n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, n.ends_sha256
from nodes n join sums s on s.key = n.key and s.depth = n.depth
left join children c on c.key = n.key and c.depth = n.depth
left join nodes p on p.key = n.above and p.depth = n.depth - 1"""


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts, every 97th (by a checksum of document and word) with one letter missing."""
    runs = read(spark, sf_dir, "documents").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.explode(spelling.letter_runs(F.col("text"))).alias("run"))
    lowered = runs.select("doc_id", spelling.lower_ascii(F.col("run")).alias("run"))
    checksum = lowered.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.when(F.col("h") % 97 == 0, F.concat(
        F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = settle(checksum.select(damaged.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(
        (F.length("word") >= 5) & (F.col("n") >= 3)))
    return spelling.group_variants(words)


SQL["op11_spelling_variants"] = rf"""
with recursive runs as (
  select coalesce(cast(doc_id as varchar), '') as doc_id, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') as run
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents)),
sums as (
  select run, c, {crc32_sql("doc_id || ':' || run")} as h
  from (select doc_id, run, count(*) as c from runs group by all)),
words as (
  select word, cast(sum(c) as bigint) as n from (
    select c, case when h % 97 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word from sums)
  where length(word) >= 5 group by word having sum(c) >= 3),
cuts as (select word, n, i, word[:i - 1] || word[i + 1:] as cut
         from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as other, b.n as n_other from cuts a join cuts b on a.cut = b.cut and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from cuts a join words b on b.word = a.cut
  union select b.word, a.word, a.n from cuts a join words b on b.word = a.cut),
best as (
  select word, count(*) as n_near, max(n_other) as most, arg_min(other, (-n_other, other)) as other from near group by word),
found as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= 2 * n then other end as form,
         case when most >= 2 * n then most end as form_n
  from words w left join best using (word)),
ways as (
  select word, word as root, 0 as steps from found
  union all select w.word, f.form, steps + 1 from ways w join found f on f.word = w.root where f.form is not null)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n
from found f join (select word, arg_max(root, steps) as root from ways group by word) r using (word)"""
