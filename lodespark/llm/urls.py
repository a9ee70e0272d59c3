"""URL filter: a blocked Bloom filter of listed canonical URLs lets possible hits through to an exact join.

Canonical: lower-case scheme and host, http for https, no user, default port, "www." or "m." in front, no fragment, no
tracking parameters (utm_*, ref, fbclid, gclid), the others sorted, no trailing slash. A key sets one bit in each of
the 8 words of one 256-bit block. The filter's size follows the list; while it is within LARGEST bytes it is sent to the
executors, and a larger one is probed by joining on the block. Either way no listed URL is missed, and the join removes false hits.

* null URL: not blocked, canonical URL null. An empty or malformed one is canonicalised as far as it goes, compared as it is.
* repeated rows give repeated rows; repeated list entries count once, null ones not at all.
* an empty list blocks nothing; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

BITS, WORDS, LARGEST = 16, 8, 64 << 20
_SALT = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def canonical(url: Column) -> Column:
    url = F.trim(url)
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(bare, "^[^?]*[?](.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"))
    front = F.regexp_replace(bare, "[?].*$", "")
    host = F.lower(F.regexp_extract(front, "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/]*)", 1))
    path = F.regexp_extract(front, "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/]*(/.*)?$", 1)
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^(www|m)[.]", "")
    sorted_ = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(sorted_ != "", F.concat(F.lit("?"), sorted_)).otherwise(F.lit("")))


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(h, 32), F.lit(blocks))


def _bits(h: Column) -> list[Column]:
    """Of each of the 8 words of 32 bits the bit that the key sets, as a mask."""
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")) for s in ((x >> 1) | 1 for x in _SALT)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0, ..., w7) of the keys h."""
    own = listed.select(_block(F.col("h"), blocks).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(_bits(F.col("h")))])
    return own.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def blocked(spark: SparkSession, pages: DataFrame, listed: DataFrame, *, bits: int = BITS, largest: int = LARGEST, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, url, canonical_url, blocked), one row per page. listed: the column canonical_url."""
    scratch = scratch or Scratch(spark)
    listed = scratch.keep(listed.select("canonical_url").filter("canonical_url is not null").distinct(), "listed")
    blocks = max(1, -(-listed.count() * bits // (32 * WORDS)))
    cells = bloom(listed.select(F.xxhash64("canonical_url").alias("h")), blocks)
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long"), url.alias("url"), canonical(url).alias("canonical_url"))
    rows = rows.withColumn("h", F.xxhash64("canonical_url"))
    if blocks * WORDS * 4 <= largest:
        found = cells.toPandas()
        words = np.zeros((blocks, WORDS), np.uint32)
        words[found["block"]] = found[[f"w{k}" for k in range(WORDS)]].to_numpy(np.uint64).astype(np.uint32)
        sent = spark.sparkContext.broadcast(words)

        @F.pandas_udf("boolean")
        def possible(h: pd.Series) -> pd.Series:
            x = h.to_numpy(np.int64)
            cell = sent.value[(x >> 32) % len(sent.value)]
            out = np.ones(len(x), bool)
            low = x & 0xFFFFFFFF
            for k, s in enumerate((x >> 1) | 1 for x in _SALT):
                with np.errstate(over="ignore"):
                    out &= (cell[:, k] >> (((low * s) & 0xFFFFFFFF) >> 27).astype(np.uint32)) & np.uint32(1) == 1
            return pd.Series(out)

        rows = rows.withColumn("possible", F.col("canonical_url").isNotNull() & possible("h"))
    else:
        rows = rows.withColumn("block", _block(F.col("h"), blocks)).join(cells, "block", "left")
        hit = F.col("canonical_url").isNotNull()
        for k, b in enumerate(_bits(F.col("h"))):
            hit = hit & (F.coalesce(F.col(f"w{k}"), F.lit(0)).bitwiseAND(b) != 0)
        rows = rows.withColumn("possible", hit)
    rows = scratch.keep(rows.select("page_id", "url", "canonical_url", "possible"), "probed")
    hits = rows.filter("possible").join(listed.withColumn("listed", F.lit(True)), "canonical_url", "left").select("page_id", "url", "canonical_url", F.coalesce("listed", F.lit(False)).alias("blocked"))
    return hits.union(rows.filter("not possible").select("page_id", "url", "canonical_url", F.lit(False).alias("blocked")))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: every page that was crawled under a tracking link, in canonical form."""
    pages = table(spark, sf_dir, "pages")
    tracked = F.col("url").rlike("[?&](utm_[a-z]+|ref|fbclid|gclid)=")
    return blocked(spark, pages, pages.filter(tracked).select(canonical(F.col("url")).alias("canonical_url")))


_CANONICAL = """
b as (select page_id, url, regexp_replace(trim(url), '#.*$', '') as bare from pages),
q as (select *, regexp_replace(bare, '[?].*$', '') as front,
             list_filter(string_split(regexp_extract(bare, '^[^?]*[?](.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')) as kept from b),
c as (select page_id, url,
             regexp_replace(regexp_replace(lower(regexp_extract(front, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/]*)', 1)), ':(80|443)$', ''), '^(www|m)[.]', '')
             || regexp_replace(regexp_extract(front, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/]*(/.*)?$', 1), '/+$', '')
             || case when len(kept) > 0 then '?' || array_to_string(list_sort(kept), '&') else '' end as canonical_url from q)
"""
ORACLE = f"""with {_CANONICAL},
l as (select distinct canonical_url from c where regexp_matches(url, '[?&](utm_[a-z]+|ref|fbclid|gclid)=') and canonical_url is not null)
select page_id, url, canonical_url, coalesce(canonical_url in (select canonical_url from l), false) as blocked from c"""
