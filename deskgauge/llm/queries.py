"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskgauge.llm import ann, bpe, centroids, conversations, mixing, quality, repeats, rules, secrets, simhash, tries, urls, warc
from deskgauge.llm.common import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def _query(name: str, oracle: str | None = None):
    def add(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER))


@_query("op1_bpe_round_trip")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


@_query("op8_simhash_components")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


_RULES_BASE = """
WITH t AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT n, list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS l FROM t),
grams AS (SELECT n, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT n, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT n, count(DISTINCT i + d) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(d) GROUP BY n),
base AS (
  SELECT n, doc_id, source, text, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t JOIN w USING (n) LEFT JOIN covered USING (n)
)"""


@_query("op2_url_verdicts", urls.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


@_query("op3_repeated_strings")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"))


@_query(
    "op4_quality_rules",
    _RULES_BASE
    + f"""
, line AS (
  SELECT n, source, lower(trim(regexp_replace(x, '[ \\t-\\r]+', ' ', 'g'))) AS x, len(list_filter(string_split_regex(x, '[ \\t-\\r]+'), lambda y: y <> '')) AS k
  FROM (SELECT n, source, unnest(l) AS x FROM t JOIN w USING (n))
), many AS (SELECT source, x, count(DISTINCT n) AS c FROM line GROUP BY ALL
), hosts AS (SELECT source, count(*) AS c FROM t GROUP BY ALL
), bad AS (SELECT many.source, x FROM many JOIN hosts ON many.source IS NOT DISTINCT FROM hosts.source WHERE many.c > greatest({rules.MIN_DOCS}, {rules.MIN_SHARE} * hosts.c)
), gone AS (SELECT n, sum(k) AS n_removed_words FROM line JOIN bad ON line.source IS NOT DISTINCT FROM bad.source AND line.x = bad.x GROUP BY n
), judged AS (
  SELECT doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
         n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
  FROM base LEFT JOIN gone USING (n)
)
SELECT *, NOT base_failed AND n_words - n_removed_words >= {rules.MIN_LEFT} * n_words AS kept FROM judged
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


@_query("op5_secret_spans")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.count_of("base", i).alias(f"n_{kind}") for i, kind in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.span_list("base"), 256).alias("base_sha256"), secrets.span_list("spans").alias("spans"))


_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, (5 * i) // 4 + 1, 2))::INT) >> (3 - (5 * i) % 4)) & 31), 1)"


@_query(
    "op6_warc_round_trip",
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS latest FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: {_BASE32}), '') AS payload_digest,
       CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < latest THEN latest END AS refers_to,
       CAST(NULL AS VARCHAR) AS error
FROM m
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(warc.write_archives(table(spark, sf_dir, "pages")), "archives")
    records = warc.read_archives(archives, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def _mix_sql(mix: mixing.Mix) -> str:
    """The mix in SQL: one water-filling step per level of the tree, then the order of each leaf's next epoch."""
    ctes, given = [], None
    for depth, level in enumerate(mixing.TREE):
        family, keys = mixing.TREE[:depth], ", ".join(mixing.TREE[: depth + 1])
        cases = " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in mix.weights.get(level, {}).items())
        weight = f"CASE {cases} ELSE {mix.other} END" if cases else f"{mix.other}"
        by = f"PARTITION BY {', '.join(family)}" if family else ""
        order = f"{by} ORDER BY capacity / w, {level} NULLS FIRST"
        parent = f"FROM n{depth} JOIN g{depth - 1} AS p ON " + " AND ".join(f"n{depth}.{f} IS NOT DISTINCT FROM p.{f}" for f in family) if family else f"FROM n{depth}"
        start = "p.budget" if family else f"(SELECT sum(held) * {mix.budget} // 1000 FROM n0)"
        own = ", ".join(f"n{depth}.{k}" for k in mixing.TREE[: depth + 1])
        ctes.append(f"""n{depth} AS (SELECT {keys}, sum(tokens)::HUGEINT * {mix.epochs} AS capacity, sum(tokens)::HUGEINT AS held FROM r GROUP BY ALL),
f{depth} AS (SELECT {own}, n{depth}.capacity, n{depth}.held, ({weight.replace(level, f'n{depth}.{level}', 1) if not cases else weight.replace(f'WHEN {level}', f'WHEN n{depth}.{level}')})::HUGEINT AS w, {start}::HUGEINT AS given {parent}),
s{depth} AS (SELECT *, given - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
  sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM f{depth}),
c{depth} AS (SELECT *, capacity * ws <= left_over * w AS fits FROM s{depth}),
g{depth} AS (SELECT {keys}, held, CASE WHEN fits THEN capacity ELSE least(capacity,
  first_value(left_over) OVER (PARTITION BY {', '.join([*family, 'fits'])} ORDER BY capacity / w, {level} NULLS FIRST) * w //
  first_value(ws) OVER (PARTITION BY {', '.join([*family, 'fits'])} ORDER BY capacity / w, {level} NULLS FIRST)) END AS budget FROM c{depth})""")
    match = " AND ".join(f"r.{c} IS NOT DISTINCT FROM l.{c}" for c in mixing.TREE)
    leaf = ", ".join(mixing.TREE)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, '')) AS identity,
         'd' || (('0x' || substr(md5(coalesce(source, '')), 1, 8))::BIGINT % 4) AS domain, lang, source,
         greatest(1, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> ''))) AS k FROM documents
), r AS (SELECT doc_id, identity, {leaf}, count(*) AS rows, sum(k) AS tokens FROM d GROUP BY ALL), {', '.join(ctes)},
l AS (SELECT *, budget // held AS whole, budget % held AS rest FROM g{len(mixing.TREE) - 1}),
o AS (SELECT r.*, whole, rest, ('0x' || substr(md5('{mix.seed}|' || whole || '|' || identity), 1, 15))::BIGINT AS draw FROM r JOIN l ON {match}),
b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {leaf} ORDER BY draw, identity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM o)
SELECT doc_id, {leaf}, rows, tokens::BIGINT AS tokens, (whole + (begins < rest)::INT)::INT AS copies FROM b
"""


@_query("op7_source_mix", _mix_sql(mixing.Mix()))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.selected(table(spark, sf_dir, "documents"))
    return chosen.select("doc_id", "domain", "lang", "source", "rows", "tokens", "copies")


@_query("op9_quality_scores")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op10_nearest_vectors")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query(
    "op12_exact_copies",
    """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.copies(table(spark, sf_dir, "documents"), keep="largest")


_CRC32 = (
    "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))))"
)


@_query(
    "op13_conversation_trie",
    f"""
WITH t AS (
  SELECT conv_id, turn, md5(length(r)::VARCHAR || ':' || r || x) AS d, len(list_filter(string_split_regex(x, '[ \\t-\\r]+'), lambda w: w <> '')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos FROM t),
ids AS (SELECT conv_id, {_CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
both_parts AS (
  SELECT ids.conv_id, 0 AS part, pos, d, words FROM ids JOIN o ON o.conv_id = ids.conv_id - ids.conv_id % 20 AND pos <= h
  UNION ALL SELECT conv_id, 1, pos, d, words FROM ids JOIN o USING (conv_id) WHERE pos > h
), s AS (SELECT conv_id, d, words, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM both_parts),
p AS (
  SELECT conv_id, depth, words, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), node AS (SELECT prefix, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(words) AS words, count(*) AS n_convs FROM p GROUP BY prefix),
kids AS (SELECT prefix[:-33] AS prefix, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
own AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (prefix)),
sums AS (
  SELECT prefix[1:32 * k] AS prefix, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM own) GROUP BY ALL
), ends AS (
  SELECT prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, prefix FROM p QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY prefix
)
SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM own JOIN sums USING (prefix) LEFT JOIN ends USING (prefix) LEFT JOIN own AS up ON own.depth > 0 AND up.prefix = own.prefix[:-33]
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(conversations.digested(table(spark, sf_dir, "conversations")), "turns")
    return conversations.prefix_tree(conversations.with_lent_beginnings(own))


def _clusters_sql() -> str:
    """Rounds of assignment and floored means, one after the other."""
    d = "list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    near = "SELECT vec_id, any_value(q) AS q, arg_min(k, d * 8 + k) AS cluster, min(d) AS distance FROM (SELECT n, vec_id, q, k, {d}::HUGEINT AS d FROM v, c{r}) GROUP BY n, vec_id"
    steps = []
    for r in range(centroids.ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(d=d, r=r)})")
        if r < centroids.ROUNDS:
            steps.append(
                f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM "
                f"(SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY ALL) GROUP BY cluster) ON cluster = k)"
            )
    last = centroids.ROUNDS
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {centroids.DIMENSIONS}
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id), q) - 1 AS k, q AS c FROM v QUALIFY k < {centroids.CLUSTERS}),
{', '.join(steps)}
SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON cluster = k
"""


@_query("op11_centroid_clusters", _clusters_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))
