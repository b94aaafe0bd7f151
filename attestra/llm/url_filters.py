"""Judge URLs by rules and by a list, with a blocked Bloom filter before an exact hash join.

Built-in functions only. Rules (host and path prefix) and listed canonical URLs become keys of one
table. A URL asks for few keys: its canonical form, and each suffix of its host with each prefix of
its path that has the length of some rule's path. The Bloom filter is a table of 64-bit words, one
block each: a key sets ``BITS`` bits of its block. A block holds all bits of a key, so a question
costs one lookup. What passes meets the key table in an exact join, which removes false positives.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and no
listed URL and gets the default verdict; repeated rows each get theirs; of equal rules the first by
verdict ("allow" before "block") holds; with empty rules and list all get the default. Only the id
and the URL are read, so extra columns cannot clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import settle

#: Keys per 64-bit block, and bits a key sets in it: about one false hit in sixty.
KEYS_PER_BLOCK = 6
BITS = 4
#: Blocks a broadcast may have, 16 bytes each; more blocks are joined by shuffle.
BROADCAST_BLOCKS = 1 << 20

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """From the end of the host to the next ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def canonical(host: Column, path: Column) -> Column:
    """Host and path without ``www.``, an index page's name, an ``.html`` ending or closing slashes."""
    bare = F.regexp_replace(host, r"^www\.|:(80|443)$", "")
    return F.concat(bare, F.regexp_replace(path, r"(/index)?(\.html?)?/*$", ""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """``BITS`` bits of a word, each from six bits of a second hash."""
    bits = F.xxhash64(F.lit("bits"), key)
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        place = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def bloom_words(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter: ``block, word`` of all blocks with a key."""
    return (keys.select(_block(F.col("key"), blocks).alias("block"), _mask(F.col("key")).alias("mask"))
            .groupBy("block").agg(F.bit_or("mask").alias("word")))


def possible(candidates: DataFrame, words: DataFrame, blocks: int) -> DataFrame:
    """The candidate rows whose ``key`` the filter cannot rule out."""
    words = F.broadcast(words) if blocks <= BROADCAST_BLOCKS else words
    asked = candidates.withColumn("block", _block(F.col("key"), blocks)).withColumn(
        "mask", _mask(F.col("key")))
    return (asked.join(words, "block")
            .where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"))
            .drop("block", "word", "mask"))


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, listed_verdict: str = "block",
               default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` and ``listed`` for each row.

    ``rules`` has ``host, path, verdict``; a rule fits its host and all subdomains when the URL's
    path starts with the rule's, and the longest rule wins. ``listed`` has canonical ``url`` keys.
    The verdict is the rule's, else ``listed_verdict`` for listed URLs, else ``default``.
    """
    rule_keys = (rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select(
        F.concat(F.lit("rule:"), "host", F.lit("\x00"), "path").alias("key"),
        F.concat("host", "path").alias("rule"), "verdict"))
    list_keys = listed.where(F.col("url").isNotNull() & (F.col("url") != "")).select("url").distinct().select(
        F.concat(F.lit("list:"), "url").alias("key"), F.lit(None).cast("string").alias("rule"),
        F.lit(listed_verdict).alias("verdict"))
    keys = settle(rule_keys.unionByName(list_keys))
    blocks = max(1, -(-keys.count() // KEYS_PER_BLOCK))
    words = settle(bloom_words(keys, blocks))
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]

    judged = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url")).select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    # The same URL asks once, however many rows carry it.
    urls = judged.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)]
    asked = [F.array(F.concat(F.lit("list:"), canonical(F.col("host"), F.col("path"))))]
    if fitting:
        asked.append(F.flatten(F.transform(F.array_compact(F.array(*fitting)), lambda p: F.transform(
            suffixes, lambda h: F.concat(F.lit("rule:"), h, F.lit("\x00"), p)))))
    candidates = urls.where(F.col("host") != "").select(
        "host", "path", F.explode(F.concat(*asked)).alias("key"))
    hits = possible(candidates, words, blocks).join(keys, "key")
    longest = F.max(F.when(F.col("rule").isNotNull(), F.struct(
        F.length("rule").alias("n"), "rule", "verdict")))
    verdicts = hits.groupBy("host", "path").agg(
        longest.alias("best"), F.max(F.when(F.col("rule").isNull(), F.col("verdict"))).alias("by_list"))
    return (judged.join(verdicts, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", "by_list", F.lit(default)).alias("verdict"),
                    F.col("by_list").isNotNull().alias("listed")))
