"""URL filters: a blocked Bloom filter before an exact hash join.

A listing holds canonical host-and-path keys with an action (allow or block). A key fits its host
and all subdomains, where the url's path starts with the key's; the longest key wins. A url
without a fitting key gets the verdict `default`.

Distinct urls come first, so a host or url that a third of all rows share is judged once. Each
url gives its candidate keys (host suffixes by listed path lengths). The Bloom filter is a table
of 256-bit blocks; its row count has a fixed bound, so it is broadcast whatever the list's size,
and only candidates whose four bits are set reach the exact join, which removes the false
positives. Verdicts go back to the rows by a join that broadcasts the few hot urls.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up
to `?`, `#` or the end; a null url or one without `://` has neither. Repeated rows, ties and
empty tables need no care: each row comes back once. All of it is DataFrame code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import cut, fresh, join_with_hot_keys, maybe_broadcast

BITS_PER_KEY = 12
#: Blocks of 32 bytes: the filter is at most 8 MB, and fuller beyond about 5.6 million keys.
MAX_BLOCKS = 1 << 18
SALTS = 16

# The rules of the query, as (host, path, action).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules(spark: SparkSession, listed: list[tuple[str, str, str]]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("rule_host", "rule_path", "action")])
    return spark.createDataFrame(listed, schema)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """The four 64-bit words with the key's four bits."""
    h = F.xxhash64(key, F.lit(1))
    bits = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(4)]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def word(w: int) -> Column:
        out = none
        for b in bits:
            out = out.bitwiseOR(F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", one, b.bitwiseAND(F.lit(63)))).otherwise(none))
        return out

    return [word(w) for w in range(4)]


def bloom(keys: DataFrame, n: int, key: str = "key") -> tuple[DataFrame, int]:
    """The filter of n keys as rows (block, w0..w3), and its number of blocks."""
    blocks = min(MAX_BLOCKS, max(1, math.ceil(n * BITS_PER_KEY / 256)))
    rows = keys.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), blocks


def possible(candidates: DataFrame, table: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """The candidates whose bits are all set."""
    kept = candidates.columns
    tested = candidates.withColumn("block", _block(F.col(key), blocks)).join(F.broadcast(table), "block")
    for i, mask in enumerate(_masks(F.col(key))):
        tested = tested.where(F.col(f"w{i}").bitwiseAND(mask) == mask)
    return tested.select(*kept)


def candidates(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """(url, key): every suffix of the host with every listed length of the path's start."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    return urls.withColumn("suffix", F.explode(suffixes)).withColumn("start", F.explode(starts)).select("url", F.concat("suffix", "start").alias("key"))


def judge_urls(pages: DataFrame, listing: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; listing is (rule_host, rule_path, action)."""
    pages = pages.drop("host", "path", "rule", "verdict")
    own = fresh("_url", pages.columns)
    pages = pages.withColumn(own, F.coalesce(F.col(url_col), F.lit("")))
    listed = cut(
        listing.select(
            F.concat(F.translate("rule_host", _UPPER, _LOWER), F.coalesce("rule_path", F.lit(""))).alias("key"),
            F.length(F.coalesce("rule_path", F.lit(""))).alias("n"),
            "action",
        )
        .where("key is not null")
        .groupBy("key")
        .agg(F.first("n").alias("n"), F.max("action").alias("action"))
    )
    n = listed.count()
    lengths = [r["n"] for r in listed.select("n").distinct().collect()]
    urls = cut(pages.groupBy(F.col(own).alias("url")).agg(F.count("*").alias("rows")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))))
    total = urls.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    table, blocks = bloom(listed, n)
    hits = possible(candidates(urls, lengths or [0]), table, blocks)
    exact = listed.select("key", "action")
    if n * 256 <= 8 << 20:
        found = hits.join(maybe_broadcast(exact, n, 256), "key")
    else:
        salt = F.array(*[F.lit(i) for i in range(SALTS)])
        found = hits.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(
            exact.withColumn("salt", F.explode(salt)).hint("shuffle_hash"), ["key", "salt"]
        )
    best = found.groupBy("url").agg(F.max_by(F.struct("key", "action"), F.struct(F.length("key"), "key")).alias("best"))
    verdicts = cut(
        urls.join(best, "url", "left").select(
            F.col("url").alias(own), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"), "rows"
        )
    )
    return join_with_hot_keys(pages, verdicts, own, "rows", total).drop(own)


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    return judge_urls(pages.select("page_id", "url"), rules(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
with p as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1) as path
  from pages
), r(rule_host, rule_path, action) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), b as (
  select host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(action, length(rule_host || rule_path)) as action
  from (select distinct host, path from p) join r
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by host, path
)
select p.page_id, p.host, p.path, b.rule, coalesce(b.action, 'allow') as verdict
from p left join b on p.host = b.host and p.path = b.path
"""
