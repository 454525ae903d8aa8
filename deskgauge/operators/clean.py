"""Normalisation with a change log, timestamp repair, quality flags and duplicate candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskgauge.functions.text import message_quality, normalize_text
from deskgauge.functions.times import ticket_time_utc
from deskgauge.params import LEGACY_SOURCE, REPORTING_ZONE

TICKET_TIMES = ("created_at", "first_response_at", "resolved_at")


def normalize_table(df: DataFrame) -> DataFrame:
    """Normalise every string column; other columns pass. Rows are never dropped."""
    return df.select(*[normalize_text(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def normalization_changes(df: DataFrame, key: str) -> DataFrame:
    """Long change log (key, column, before, after) of every string cell that normalisation alters.

    ``after`` is blank where the cell became missing; the business key identifies the row.
    """
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(F.col(c), F.lit("")).alias("before"),
            F.coalesce(normalize_text(F.col(c)), F.lit("")).alias("after"),
        )
        for c, t in df.dtypes
        if t == "string"
    ]
    changed = F.filter(F.array(*cells), lambda x: x["before"] != x["after"])
    return df.select(F.col(key).alias("row_key"), F.inline(changed))


def repair_ticket_times(df: DataFrame, zone: str = REPORTING_ZONE, fields: Sequence[str] = TICKET_TIMES) -> DataFrame:
    """UTC timestamps with the raw text kept, and whether and why a zone was assumed."""
    parsed = {f"__{f}": ticket_time_utc(F.col(f), F.col("source_system"), f, zone) for f in fields}
    staged = df.withColumns({**{f"{f}_raw": F.coalesce(f, F.lit("")) for f in fields}, **parsed})
    assumed = F.lit(False)
    for f in fields:
        assumed = assumed | F.coalesce(F.col(f"__{f}.assumed_zone"), F.lit(False))
    return staged.withColumns(
        {
            **{f: F.col(f"__{f}.ts") for f in fields},
            "timestamp_normalization_applied": assumed,
            "timestamp_normalization_reason": F.when(
                F.col("source_system") == LEGACY_SOURCE, "legacy_resolved_utc"
            ).otherwise("helpdesk_ist"),
        }
    ).drop(*parsed)


def flag_message_quality(df: DataFrame, message: str = "customer_message") -> DataFrame:
    return (
        df.withColumn("__q", message_quality(F.col(message)))
        .withColumns({"text_quality_flag": F.col("__q.flag"), "text_quality_reason": F.col("__q.reason")})
        .drop("__q")
    )


def flag_duplicate_candidates(df: DataFrame, fields: Sequence[str] = ("customer_id", "product_sku", "created_at")):
    """Flag tickets whose customer, product and creation time occur in more than one source system.

    The keys seen in several sources are found by a map-side combined aggregation and joined back, so a frequent key
    never gathers its tickets in one task.
    """
    folded = [F.lower(F.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))) for f in fields]
    names = [f"__k{i}" for i in range(len(fields))]
    keyed = df.withColumns(dict(zip(names, folded, strict=True)))
    source = F.coalesce("source_system", F.lit(""))
    present = F.lit(True)
    for n in names:
        present = present & (F.col(n) != "")
    several = (
        keyed.filter(present)
        .groupBy(*names)
        .agg(F.min(source).alias("lo"), F.max(source).alias("hi"))
        .filter("lo <> hi")
        .select(*names, F.lit(True).alias("__several"))
    )
    flag = F.coalesce("__several", F.lit(False))
    return (
        keyed.join(several, names, "left")
        .withColumns(
            {
                "reconciliation_flag": flag,
                "reconciliation_reason": F.when(flag, "cross_source_same_customer_product_created_at").otherwise(""),
            }
        )
        .select(*df.columns, "reconciliation_flag", "reconciliation_reason")
    )


def flag_date_anomalies(df: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Linked order before the customer's signup, and ticket created before the product's launch."""
    signup = customers.select(F.col("customer_id").alias("__c"), F.to_date("signup_date").alias("__signup"))
    launch = products.select(F.col("sku").alias("__s"), F.to_date("launch_date").alias("__launch"))
    joined = df.join(signup, F.col("customer_id") == F.col("__c"), "left").join(
        launch, F.col("product_sku") == F.col("__s"), "left"
    )
    return joined.select(
        *[df[c] for c in df.columns],
        F.coalesce(F.to_date("linked_order_date") < F.col("__signup"), F.lit(False)).alias("signup_anomaly_flag"),
        F.coalesce(F.to_date("created_at") < F.col("__launch"), F.lit(False)).alias("product_prelaunch_anomaly_flag"),
    )


def orders_before_signup(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """One row: orders dated before their customer's signup."""
    joined = orders.join(customers.select("customer_id", "signup_date"), "customer_id")
    early = F.to_date("order_date") < F.to_date("signup_date")
    return joined.agg(F.count(F.lit(1)).alias("linked_orders"), F.count_if(early).alias("orders_before_signup"))


def negative_intervals(df: DataFrame) -> DataFrame:
    """One row: tickets resolved before their first response."""
    return df.agg(
        F.count(F.lit(1)).alias("ticket_count"),
        F.count_if(F.col("resolved_at") < F.col("first_response_at")).alias("negative_interval_count"),
    )
