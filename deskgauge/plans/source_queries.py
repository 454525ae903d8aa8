"""Sources and sinks: tables are written to a fresh scratch folder and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgauge.operators import economics, products, textreview
from deskgauge.plans.adapters import EVENT_TICKETS_SQL, event_tickets, table
from deskgauge.plans.catalog import out, query, scratch, with_sql
from deskgauge.plans.decision_queries import DECISIONS_SQL, rows
from deskgauge.plans.money_queries import (
    _LEVELS,
    _PROD_N,
    _PROD_X,
    ENRICHED_SQL,
    SUPPORT,
    _product_sql,
    economics_table,
    enriched_table,
)
from deskgauge.plans.money_queries import _TOTALS_SQL as TOTALS_SQL
from deskgauge.plans.text_queries import VALIDATED_SQL, validated_table
from deskgauge.sources import readers, sinks


@query(
    "src1_load_csv",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_hash, lang, source FROM documents",
)
def _csv(spark, sf):
    path = scratch(spark, "csv")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.write.options(header=True, quoteAll=True, escape='"', **keep).csv(path)
    loaded = readers.load_csv(spark, path, multiline=True)  # texts hold line breaks
    return loaded.select("doc_id", F.md5("text").alias("text_hash"), "lang", "source")


@query("src2_load_text", "SELECT CAST(sum(length(html) + 1) AS BIGINT) AS characters FROM pages")
def _text(spark, sf):
    path = scratch(spark, "text")
    table(spark, sf, "pages").select("html").write.text(path)
    return readers.load_text(spark, path).agg(F.sum(F.length("value")).alias("characters"))


_FILES = (
    "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier"
).split()


def _row_counts(spark, sf, names):
    """(name, rows) of the files of the given tables."""
    counts = [table(spark, sf, f).agg(F.lit(f"{f}.parquet").alias("name"), F.count(F.lit(1)).alias("rows")) for f in names]
    return reduce(DataFrame.union, counts)


@query(
    "src3_file_inventory",
    " UNION ALL ".join(
        f"SELECT '{f}.parquet' AS name, true AS has_size, false AS content_extracted, count(*) AS rows FROM {f}" for f in _FILES
    ),
)
def _inventory(spark, sf):
    files = readers.file_inventory(spark, sf, "*.parquet")
    listed = files.join(_row_counts(spark, sf, _FILES), "name", "left")
    return listed.select("name", (F.col("size_bytes") > 0).alias("has_size"), "content_extracted", "rows")


@query(
    "src4_check_file_presence",
    """SELECT 'orders.parquet' AS name, true AS present, count(*) AS rows FROM orders
       UNION ALL SELECT 'lineitem.parquet', true, count(*) FROM lineitem UNION ALL SELECT 'policy.pdf', false, NULL""",
)
def _presence(spark, sf):
    found = readers.check_file_presence(spark, sf, ["orders.parquet", "lineitem.parquet", "policy.pdf"])
    return found.join(_row_counts(spark, sf, ("orders", "lineitem")), "name", "left").select("name", "present", "rows")


@query("src5_scan_parquet", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def _scan(spark, sf):
    lines = readers.scan_parquet(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_suppkey"])
    return lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("src6_scan_ids", "SELECT o_orderkey FROM orders")
def _ids(spark, sf):
    return readers.scan_ids(spark, f"{sf}/orders.parquet", "o_orderkey")


@query(
    "src7_load_json_lines",
    with_sql(EVENT_TICKETS_SQL, "SELECT ticket_id, category AS issue_category FROM event_tickets WHERE category <> 'error'"),
)
def _json(spark, sf):
    path = scratch(spark, "jsonl")
    t = event_tickets(spark, sf)
    line = F.to_json(F.struct("ticket_id", F.col("category").alias("issue_category")))
    broken = F.concat(F.lit('{"ticket_id": '), F.col("ticket_id"), F.lit(", oops"))
    t.select(F.when(t.category == "error", broken).otherwise(line).alias("value")).write.text(path)
    loaded = readers.load_json_lines(spark, path, "ticket_id string, issue_category string")
    return loaded.select("ticket_id", "issue_category")


@query("src8_load_json_lines_strict", "SELECT doc_id, quality, toxic FROM labels")
def _json_strict(spark, sf):
    path = scratch(spark, "labels")
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    labels.write.json(path)
    schema = "doc_id bigint, quality int, toxic int"
    return readers.load_json_lines_strict(spark, path, schema, "doc_id", ["quality"], labels.count())


@query(
    "snk1_write_table",
    "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS line_numbers FROM lineitem GROUP BY l_returnflag",
)
def _parquet(spark, sf):
    path = scratch(spark, "lineitem")
    sinks.write_table(table(spark, sf, "lineitem"), path, ["l_returnflag"])
    back = spark.read.parquet(path)
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("line_numbers"))


@query(
    "snk2_write_report",
    with_sql(
        TOTALS_SQL,
        """SELECT (SELECT count(*) FROM econ) AS ticket_rows, CAST(contact_cost_inr AS DOUBLE) AS contact_cost,
             CAST(total_relevant_exposure_inr AS DOUBLE) AS total_exposure FROM totals""",
    ),
)
def _report(spark, sf):
    path = scratch(spark, "report")
    money = economics_table(spark, sf)
    report = sinks.nested_report(
        counts=money.agg(F.count(F.lit(1)).alias("ticket_rows")), exposure=economics.exposure_totals(money)
    )
    sinks.write_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    return back.select(
        "counts.ticket_rows",
        F.col("exposure.contact_cost_inr").alias("contact_cost"),
        F.col("exposure.total_relevant_exposure_inr").alias("total_exposure"),
    )


_STACKED = " UNION ALL ".join(
    f"""SELECT '{level}' AS analysis_level, {dim} AS dimension, {sku} AS product_sku, {agent} AS agent_id, {out('support_status', _PROD_N, _PROD_X, 'replacement_exposure_inr')}
        FROM ({_product_sql(*_LEVELS[level])})"""
    for level, dim, sku, agent in (
        ("product_sku", "product_sku", "product_sku", "NULL"),
        ("product_family", "product_family", "NULL", "NULL"),
        ("order_channel", "order_channel", "NULL", "NULL"),
        ("lot", "order_lot_code", "product_sku", "NULL"),
        ("agent_product", "product_sku", "product_sku", "agent_id"),
    )
)


@query("snk3_stacked_csv", with_sql(ENRICHED_SQL, _STACKED))
def _stacked(spark, sf):
    path = scratch(spark, "stacked")
    long = products.stacked_levels(products.product_levels(enriched_table(spark, sf), SUPPORT))
    long.write.option("header", True).csv(path)
    return spark.read.schema(long.schema).option("header", True).csv(path)


@query(
    "snk4_export_csv",
    with_sql(
        DECISIONS_SQL,
        """SELECT agent AS agent_id, agent_tier AS tier, priority_status, round(priority_score, 6) + 0.0 AS priority_score,
             stability_state AS stability FROM ranked""",
    ),
)
def _export(spark, sf):
    path = scratch(spark, "export")
    sinks.export_csv(rows(spark, sf), path, sinks.EXPORT_COLUMNS["training_priority"])
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(
        "agent_id", "tier", "priority_status", F.col("priority_score").cast("double").alias("priority_score"),
        F.get_json_object("stability", "$.state").alias("stability"),
    )


# only accepted results enter the cache; every other request is a miss
@query(
    "snk5_result_cache",
    with_sql(VALIDATED_SQL, "SELECT ticket_id, rule IS NULL AS cache_hit FROM validated"),
)
def _cache(spark, sf):
    path = scratch(spark, "cache")
    v = validated_table(spark, sf)
    request = F.concat_ws(" ", "ticket_id", F.col("sources")[0])
    keyed = v.withColumn("request_key", textreview.cache_key(request, F.lit("rules"), F.lit("v1")))
    sinks.cache_append(keyed.filter("is_valid").withColumn("value", F.col("payload")), path)
    found = sinks.cache_lookup(keyed.select("ticket_id", "request_key"), spark.read.parquet(path))
    return found.select("ticket_id", "cache_hit")


def _keyed_requests(spark, sf):
    """Requests of all predictions, and a cache into which the accepted ones were merged twice."""
    v = validated_table(spark, sf)
    request = F.concat_ws(" ", "ticket_id", F.col("sources")[0])
    keyed = v.withColumn("request_key", textreview.cache_key(request, F.lit("rules"), F.lit("v1")))
    cache = sinks.KeyedCache(spark, f"result_cache_{uuid.uuid4().hex}")
    accepted = keyed.filter("is_valid").select("request_key", F.col("payload").alias("value"))
    cache.merge(accepted)
    cache.merge(accepted)
    return keyed, cache


@query(
    "snk5_keyed_cache",
    with_sql(VALIDATED_SQL, "SELECT ticket_id, rule IS NULL AS cache_hit, CASE WHEN rule IS NULL THEN 1 ELSE 0 END AS rows FROM validated"),
)
def _keyed_cache(spark, sf):
    """Hits, and how many rows the cache holds for the request after the same results came twice."""
    keyed, cache = _keyed_requests(spark, sf)
    held = cache.read().groupBy("request_key").agg(F.count("*").cast("int").alias("rows"))
    found = cache.lookup(keyed.select("ticket_id", "request_key")).join(held, "request_key", "left")
    return found.select("ticket_id", "cache_hit", F.coalesce("rows", F.lit(0)).alias("rows"))


@query("snk5_cache_misses", with_sql(VALIDATED_SQL, "SELECT ticket_id, rule FROM validated WHERE rule IS NOT NULL"))
def _cache_misses(spark, sf):
    keyed, cache = _keyed_requests(spark, sf)
    return cache.misses(keyed.select("ticket_id", "rule", "request_key")).select("ticket_id", "rule")


_BUNDLE = {
    "region": ["r_regionkey", "r_name"],
    "supplier": ["s_suppkey", "s_nationkey"],
    "orders": ["o_orderkey", "o_orderstatus", "o_totalprice"],
}


def _bundle(spark, sf):
    folder = scratch(spark, "bundle")
    manifest = sinks.publish_bundle({n: (table(spark, sf, n), c) for n, c in _BUNDLE.items()}, folder)
    return folder, manifest


@query(
    "snk6_publish_bundle",
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", count(*) AS row_count, '{','.join(c)}' AS columns FROM {n}" for n, c in _BUNDLE.items()
    ),
)
def _publish(spark, sf):
    return _bundle(spark, sf)[1].select("table", "row_count", "columns")


@query(
    "snk7_validate_bundle",
    " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS row_count, 'valid' AS status FROM {n}" for n in _BUNDLE),
)
def _validate(spark, sf):
    return sinks.validate_bundle(spark, _bundle(spark, sf)[0])
