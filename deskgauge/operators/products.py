"""Product, family, order-channel, lot and agent-product analysis of linked tickets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgauge.functions.keys import join_null_safe
from deskgauge.operators.link import link_orders_checked

MINIMUM_SUPPORT = 30
_MEASURES = (
    "ticket_count",
    "completed_ticket_count",
    "replacement_eligible_count",
    "replacement_count",
    "replacement_rate",
    "replacement_exposure_inr",
    "csat_response_count",
    "mean_csat",
    "support_status",
)


def enrich_tickets(tickets: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """One row per ticket: checked order link, product facts and the flags the aggregates read.

    ``tickets`` carries ticket metrics and exposures on one row.
    """
    linked = link_orders_checked(tickets, orders)
    facts = products.select(
        F.col("sku").alias("__sku"), "product_name", F.col("family").alias("product_family"), "warranty_months"
    )
    recorded = F.upper(F.trim("replacement_issued"))
    eligible = F.coalesce(recorded.isin("Y", "N"), F.lit(False))
    scored = F.col("attendance_flag") & F.col("valid_for_csat") & F.col("csat_score_numeric").isNotNull()
    kept = (
        "ticket_id customer_id order_id source_order_id order_match_status order_match_method order_channel order_lot_code "
        "order_date order_quantity order_value_inr product_sku agent_id"
    ).split()
    return linked.join(facts, F.col("product_sku") == F.col("__sku"), "left").select(
        *kept,
        "product_name",
        "product_family",
        "warranty_months",
        F.col("attendance_flag").alias("completed"),
        eligible.alias("replacement_eligible"),
        (eligible & (recorded == "Y")).alias("replacement"),
        F.coalesce("replacement_exposure_inr", F.lit(0).cast("decimal(18,2)")).alias("replacement_exposure_inr"),
        scored.alias("csat_valid"),
        F.when(scored, F.col("csat_score_numeric")).alias("csat_score"),
    )


def product_aggregate(rows: DataFrame, keys: Sequence[str], minimum_support: int = MINIMUM_SUPPORT) -> DataFrame:
    """Counts, replacement rate, exposure, satisfaction and support label per key."""
    if minimum_support < 1:
        raise ValueError(f"minimum_support is {minimum_support}, needs 1 or more")
    eligible, replaced = F.count_if("replacement_eligible"), F.count_if("replacement")
    measures = [
        F.count(F.lit(1)).alias("ticket_count"),
        F.count_if("completed").alias("completed_ticket_count"),
        eligible.alias("replacement_eligible_count"),
        replaced.alias("replacement_count"),
        F.try_divide(replaced, eligible).alias("replacement_rate"),
        F.coalesce(F.sum("replacement_exposure_inr"), F.lit(0)).cast("decimal(18,2)").alias("replacement_exposure_inr"),
        F.count("csat_score").alias("csat_response_count"),
        F.avg("csat_score").alias("mean_csat"),
        F.when(eligible >= minimum_support, "supported").otherwise("below_minimum_support").alias("support_status"),
    ]
    return rows.groupBy(*keys).agg(*measures)


_PRODUCT = ["product_sku", "product_name", "product_family"]


def product_levels(enriched: DataFrame, minimum_support: int = MINIMUM_SUPPORT) -> dict[str, DataFrame]:
    """Aggregates by product, family, order channel, lot and agent x product. Lots below support are suppressed."""
    matched = enriched.filter("order_match_status = 'matched'")
    lots = product_aggregate(
        matched.filter("order_lot_code is not null"), [*_PRODUCT, "order_lot_code"], minimum_support
    )
    return {
        "product_sku": product_aggregate(enriched.filter("product_sku is not null"), _PRODUCT, minimum_support),
        "product_family": product_aggregate(
            enriched.filter("product_family is not null"), ["product_family"], minimum_support
        ),
        "order_channel": product_aggregate(
            matched.filter("order_channel is not null"), ["order_channel"], minimum_support
        ),
        "lot_all": lots,
        "lot": lots.filter(F.col("replacement_eligible_count") >= minimum_support),
        "agent_product": agent_product_shares(enriched, minimum_support),
    }


def agent_product_shares(enriched: DataFrame, minimum_support: int = MINIMUM_SUPPORT) -> DataFrame:
    """Agent x product rows with their share of the product's and of the agent's tickets."""
    pairs = product_aggregate(
        enriched.filter("agent_id is not null and product_sku is not null"), ["agent_id", *_PRODUCT], minimum_support
    )
    by_product = enriched.filter("product_sku is not null").groupBy("product_sku").agg(
        F.count(F.lit(1)).alias("product_ticket_count")
    )
    by_agent = enriched.filter("agent_id is not null").groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("agent_ticket_count")
    )
    joined = pairs.join(by_product, "product_sku", "left").join(by_agent, "agent_id", "left")
    return joined.withColumns(
        {
            "share_of_product_tickets": F.col("ticket_count") / F.col("product_ticket_count"),
            "share_of_agent_tickets": F.col("ticket_count") / F.col("agent_ticket_count"),
        }
    )


def one_versus_rest(enriched: DataFrame) -> DataFrame:
    """Every product against all other tickets: totals minus own, so one aggregation serves all products."""
    sums = {
        "ticket_count": F.count(F.lit(1)),
        "replacement_eligible_count": F.count_if("replacement_eligible"),
        "replacement_count": F.count_if("replacement"),
        "replacement_exposure_inr": F.coalesce(F.sum("replacement_exposure_inr"), F.lit(0)),
        "csat_response_count": F.count("csat_score"),
        "csat_sum": F.coalesce(F.sum("csat_score"), F.lit(0)),
    }
    own = enriched.groupBy("product_sku").agg(*[v.alias(k) for k, v in sums.items()])
    rest = {f"other_{k}": own.agg(F.sum(k)).scalar() - F.col(k) for k in sums}
    wide = own.filter("product_sku is not null").withColumns(rest)
    return wide.select(
        "product_sku",
        "ticket_count",
        F.try_divide("replacement_count", "replacement_eligible_count").alias("replacement_rate"),
        F.try_divide("csat_sum", "csat_response_count").alias("mean_csat"),
        "other_ticket_count",
        "other_replacement_eligible_count",
        "other_replacement_count",
        F.try_divide("other_replacement_count", "other_replacement_eligible_count").alias("other_replacement_rate"),
        F.col("other_replacement_exposure_inr").cast("decimal(18,2)"),
        "other_csat_response_count",
        F.try_divide("other_csat_sum", "other_csat_response_count").alias("other_mean_csat"),
    )


def product_agent_exposure(agent_product: DataFrame, minimum_support: int = MINIMUM_SUPPORT) -> DataFrame:
    """Per product: spread of supported agents' volumes, rates and shares."""
    supported = agent_product.filter(F.col("replacement_eligible_count") >= minimum_support)
    return supported.groupBy("product_sku").agg(
        F.count(F.lit(1)).alias("supported_agent_count"),
        F.min("ticket_count").alias("ticket_count_min"),
        F.max("ticket_count").alias("ticket_count_max"),
        F.min("replacement_rate").alias("replacement_rate_min"),
        F.max("replacement_rate").alias("replacement_rate_max"),
        F.max("share_of_product_tickets").alias("max_share_of_product_tickets"),
    )


def match_coverage(enriched: DataFrame) -> DataFrame:
    """One row: tickets by link status, match rate and the share of replacements that are linked."""
    status = F.col("order_match_status")
    return enriched.agg(
        F.count(F.lit(1)).alias("ticket_count"),
        *[F.count_if(status == s).alias(f"{s}_count") for s in ("matched", "ambiguous", "unmatched")],
        F.try_divide(F.count_if(status == "matched"), F.count(F.lit(1))).alias("order_match_rate"),
        F.count_if("replacement").alias("replacement_count"),
        F.try_divide(F.count_if(F.col("replacement") & (status == "matched")), F.count_if("replacement")).alias(
            "replacement_order_match_coverage"
        ),
    )


def top_products(by_product: DataFrame, minimum_support: int = MINIMUM_SUPPORT, k: int = 5) -> DataFrame:
    """Three top-k lists: replacement rate, exposure, lowest satisfaction; ties by product."""
    lists = {
        "top_replacement_rate": (
            by_product.filter(F.col("replacement_eligible_count") >= minimum_support),
            F.coalesce("replacement_rate", F.lit(0.0)).desc(),
        ),
        "top_replacement_exposure": (by_product, F.col("replacement_exposure_inr").desc()),
        "lowest_csat": (
            by_product.filter(F.col("csat_response_count") >= minimum_support),
            F.col("mean_csat").asc_nulls_last(),
        ),
    }
    parts = [
        rows.orderBy(order, "product_sku").limit(k).select(F.lit(name).alias("list_name"), "product_sku", *_MEASURES)
        for name, (rows, order) in lists.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stacked_levels(levels: dict[str, DataFrame]) -> DataFrame:
    """The five aggregates in one long table keyed by level and dimension."""
    dimension = {
        "product_sku": "product_sku",
        "product_family": "product_family",
        "order_channel": "order_channel",
        "lot": "order_lot_code",
        "agent_product": "product_sku",
    }
    parts = None
    for level, column in dimension.items():
        rows = levels[level]
        optional = [c for c in ("product_sku", "agent_id") if c in rows.columns]
        part = rows.select(F.lit(level).alias("analysis_level"), F.col(column).alias("dimension"), *optional, *_MEASURES)
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    return parts.select("analysis_level", "dimension", "product_sku", "agent_id", *_MEASURES)


def with_exposure(metrics: DataFrame, economics: DataFrame) -> DataFrame:
    """Metric rows with the replacement exposure of the same ticket."""
    return join_null_safe(metrics, economics.select("ticket_id", "replacement_exposure_inr"), ["ticket_id"], "inner")
