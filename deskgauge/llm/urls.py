"""URL filters: host and path rules first, then a list of canonical URLs.

A blocked Bloom filter of the listed URLs passes possible hits to an exact hash join, which removes the false ones. Only
Spark's own functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): the policy of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Host words of the sites that the registered query lists.
LISTED_WORDS = ("adult", "casino", "cheap-pills", "porn", "warez")
#: Blocks of 4 x 64 bits. This bounds the filter, and what is broadcast, to about 6 MB for a list of any length: at 12 bits
#: an entry it holds 2.8 million; a longer list passes more rows on to the exact join, and no result changes.
BLOCKS = 1 << 17
WORDS, PROBES = 4, 8
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, ``m.`` or a default port; path without a last slash; query sorted, without tracking names; no
    scheme and no fragment. Null where the url has no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    own = F.array_join(F.sort_array(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"))), "&")
    return F.when(host != "", F.concat(host, path, F.when(own != "", F.concat(F.lit("?"), own)).otherwise(F.lit(""))))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<size, rule, verdict> of the longest rule that fits, else null; of equal lengths the longer path, then block.

    The rules are a short policy that travels in the plan.
    """
    found = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(len(p)).alias("path_size"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")))
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*found)))


def _block(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(BLOCKS))


def _masks(url: Column) -> list[Column]:
    """``WORDS`` longs in which the bits of a url are set, from slices of a second hash."""
    second = F.xxhash64(F.lit("bits"), url)
    at = [F.shiftrightunsigned(second, 8 * i).bitwiseAND(255).cast("int") for i in range(PROBES)]
    bits = [(F.shiftright(a, 6), F.expr("1L"), a.bitwiseAND(63)) for a in at]
    out = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for word, one, bit in bits:
            mask = mask.bitwiseOR(F.when(word == w, F.call_function("shiftleft", one, bit)).otherwise(F.lit(0).cast("long")))
        out.append(mask)
    return out


def bloom_filter(listed: DataFrame) -> DataFrame:
    """(block, b0..b3): one row per block in use, so ``BLOCKS`` rows at most; masks are combined on the map side first."""
    names = [f"b{i}" for i in range(WORDS)]
    rows = listed.select(_block(F.col("url")).alias("block"), *[m.alias(n) for m, n in zip(_masks(F.col("url")), names, strict=True)])
    return rows.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names])


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", page_id: str = "page_id", rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, canonical, possible (the filter passed the url on), listed.

    ``listed`` has a column ``url`` of canonical URLs (null and repeated ones don't matter). Null urls and urls without
    ``://`` have empty host and path, fit no rule and aren't listed. Repeated rows stay; an empty list blocks nothing.
    """
    known = listed.where("url is not null").select("url").distinct()
    filled = bloom_filter(known).withColumnsRenamed({f"b{i}": f"f{i}" for i in range(WORDS)}).withColumnRenamed("block", "own_block")
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), canonical(F.col(url)).alias("canonical"))
    rows = rows.select("*", matching_rule(F.col("host"), F.col("path"), rules).alias("fit"))
    rows = rows.select("*", F.coalesce(_block(F.col("canonical")), F.lit(-1).cast("long")).alias("block"), *[m.alias(f"b{i}") for i, m in enumerate(_masks(F.col("canonical")))])
    rows = rows.join(F.broadcast(filled), F.col("block") == F.col("own_block"), "left")  # at most BLOCKS rows
    hit = F.col("canonical").isNotNull() & F.col("own_block").isNotNull()
    for i in range(WORDS):
        hit = hit & (F.col(f"f{i}").bitwiseAND(F.col(f"b{i}")) == F.col(f"b{i}"))
    rows = rows.select("page_id", "host", "path", "fit", "canonical", F.coalesce(hit, F.lit(False)).alias("possible"))
    # a url that many pages share is spread over SALTS groups; the list is repeated for them, each url once in each
    salted = known.select(F.col("url").alias("known"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    possible = rows.where("possible").withColumn("own_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    sure = possible.join(salted.hint("shuffle_hash"), (F.col("canonical") == F.col("known")) & (F.col("own_salt") == F.col("salt")), "left")
    out = sure.select("page_id", "host", "path", "fit", "canonical", "possible", F.col("known").isNotNull().alias("listed"))
    out = out.union(rows.where("not possible").select("*", F.lit(False).alias("listed")))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "canonical", "possible", "listed")


def listed_urls(pages: DataFrame, url: str = "url", words=LISTED_WORDS) -> DataFrame:
    """The block list of the registered query: canonical URLs of the pages on hosts with one of ``words`` in their name."""
    host = host_of(F.col(url))
    wanted = F.lit(False)
    for word in words:
        wanted = wanted | host.contains(word)
    return pages.where(wanted).select(canonical(F.col(url)).alias("url"))


_WORDS_SQL = " OR ".join(f"contains(host, '{w}')" for w in LISTED_WORDS)
_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

#: A page is listed if and only if its own host has one of the words: its canonical url holds the host.
ORACLE = f"""
WITH u AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), r(v, h, p) AS (VALUES {_RULES_SQL}
), best AS (
  SELECT n, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {_WORDS_SQL} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (n)
"""
