"""Ticket exposures from policy rates, their rollups, trends and scenarios. Money is DECIMAL(18,2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskgauge.functions.keys import FULL_PERIOD, PERIOD, explode_periods
from deskgauge.operators.link import detect_repeat_contacts
from deskgauge.params import ASSIGNMENT, ServicePolicy

MONEY = "decimal(18,2)"
SUM_FIELDS = (
    "contact_cost_inr",
    "sla_breach_cost_inr",
    "transfer_cost_inr",
    "replacement_cost_inr",
    "refund_amount_inr",
    "repeat_contact_cost_inr",
    "operational_cost_exposure_inr",
    "internal_transfer_cost_exposure_inr",
    "replacement_exposure_inr",
    "refund_exposure_inr",
    "total_relevant_exposure_inr",
)
SCENARIO_RATES = (0.10, 0.20, 0.30)
REPEAT_SUBSET = "repeat_contact_candidate_subset_of_contact"
# --- fixed values: scenario drivers and the summed column of each -------------------------------------------------
DRIVERS = {
    "contact": "contact_cost_inr",
    "sla_breach": "sla_breach_cost_inr",
    "transfers": "transfer_cost_inr",
    "replacement_known_cost": "replacement_cost_inr",
    "refund_amount": "refund_amount_inr",
    REPEAT_SUBSET: "repeat_contact_cost_inr",
}


def money(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast(MONEY)


def contact_cost(channel: Column, policy: ServicePolicy = ServicePolicy()) -> Column:
    rates = F.create_map(*[x for k, v in policy.contact_cost.items() for x in (F.lit(k), money(v))])
    return F.try_element_at(rates, F.lower(F.trim(F.coalesce(channel, F.lit("")))))


def is_replacement(flag: Column) -> Column:
    return F.upper(F.trim(F.coalesce(flag, F.lit("")))) == "Y"


PRODUCT_FIELDS = ("replacement_product_family", "replacement_unit_cost_inr")


def with_replacement_product(tickets: DataFrame, products: DataFrame) -> DataFrame:
    """Family and unit cost of the replaced product, null where no replacement was issued. It needs raw tickets only, so it may
    come before the metrics, when rows are narrow."""
    lookup = products.select(
        F.col("sku").alias("__sku"),
        F.col("family").alias("__family"),
        F.col("unit_cost_inr").cast(MONEY).alias("__unit_cost"),
    ).dropDuplicates(["__sku"])
    replaced = is_replacement(F.col("replacement_issued"))
    rows = tickets.join(lookup, replaced & (F.col("product_sku") == F.col("__sku")), "left")
    return rows.select(*[tickets[f"`{c}`"] for c in tickets.columns], *[F.col(a).alias(b) for a, b in zip(("__family", "__unit_cost"), PRODUCT_FIELDS, strict=True)])


def ticket_economics(
    metrics: DataFrame, products: DataFrame, policy: ServicePolicy = ServicePolicy(), strict: bool = False
) -> DataFrame:
    """Exposures per ticket. Products are joined only where a replacement was issued, and not again if the rows have them
    (``with_replacement_product``).

    Unsupported channels and negative amounts are flagged; ``strict`` raises on the first one instead.
    """
    replaced = is_replacement(F.col("replacement_issued"))
    rows = metrics if set(PRODUCT_FIELDS) <= set(metrics.columns) else with_replacement_product(metrics, products)
    contact = contact_cost(F.col("channel"), policy)
    refund = F.coalesce(F.col("refund_amount_inr").cast(MONEY), money(0))
    transfers = F.coalesce(F.col("transfers_numeric"), F.lit(0))
    bad = contact.isNull() | (refund < 0) | (transfers < 0)
    if strict:
        message = F.concat(F.lit("unsupported channel or negative amount on ticket "), F.col("ticket_id").cast("string"))
        contact = F.when(bad, F.raise_error(message).cast(MONEY)).otherwise(contact)
    breached = F.coalesce("sla_breach_flag", F.lit(False))
    replacement = F.when(replaced, money(F.col("replacement_unit_cost_inr") + money(policy.logistics_cost))).otherwise(money(0))
    sla, transfer = F.when(breached, money(policy.sla_credit)).otherwise(money(0)), money(transfers * money(policy.transfer_cost))
    operational = money(F.coalesce(contact, money(0)) + sla + transfer)
    known = F.coalesce(replacement, money(0))
    anomaly = replaced & (refund > 0)
    return rows.select(
        *[metrics[c] for c in metrics.columns if c not in ("refund_amount_inr", "sla_breach_flag", "product_family", *PRODUCT_FIELDS)],
        "replacement_product_family",
        breached.alias("sla_breach_flag"),
        F.coalesce("valid_for_sla", F.lit(False)).alias("sla_eligible_flag"),
        transfers.alias("transfers_count"),
        replaced.alias("replacement_issued_flag"),
        "replacement_unit_cost_inr",
        (replaced & replacement.isNull()).alias("replacement_cost_missing_flag"),
        bad.alias("economics_input_error_flag"),
        anomaly.alias("refund_replacement_anomaly_flag"),
        F.when(anomaly, money(refund + known)).otherwise(money(0)).alias("refund_replacement_anomaly_exposure_inr"),
        contact.alias("contact_cost_inr"),
        sla.alias("sla_breach_cost_inr"),
        transfer.alias("transfer_cost_inr"),
        replacement.alias("replacement_cost_inr"),
        refund.alias("refund_amount_inr"),
        operational.alias("operational_cost_exposure_inr"),
        transfer.alias("internal_transfer_cost_exposure_inr"),
        replacement.alias("replacement_exposure_inr"),
        refund.alias("refund_exposure_inr"),
        money(operational + known + refund).alias("total_relevant_exposure_inr"),
    )


def with_repeat_cost(tickets: DataFrame, policy: ServicePolicy = ServicePolicy()) -> DataFrame:
    """Repeat-contact match and its cost: the contact cost of the later ticket, a subset of contact cost. Rows that were matched
    before their metrics were derived keep their match."""
    known = "repeat_contact_candidate_flag" in tickets.columns
    matched = tickets if known else detect_repeat_contacts(tickets, policy.repeat_window_days)
    cost = F.when(F.col("repeat_contact_candidate_flag"), F.col("contact_cost_inr")).otherwise(money(0))
    return matched.withColumn("repeat_contact_cost_inr", cost)


def calculate_ticket_economics(
    metrics: DataFrame, products: DataFrame, policy: ServicePolicy = ServicePolicy(), strict: bool = False
) -> DataFrame:
    return with_repeat_cost(ticket_economics(metrics, products, policy, strict), policy)


# --- rollups ------------------------------------------------------------------------------------------------------
def economics_measures() -> dict[str, Column]:
    known = F.col("replacement_cost_inr").isNotNull() & F.col("replacement_issued_flag")
    return {
        "ticket_count": F.count(F.lit(1)),
        "completed_ticket_count": F.count_if("attendance_flag"),
        "sla_eligible_count": F.count_if("sla_eligible_flag"),
        "sla_breach_count": F.count_if("sla_breach_flag"),
        "transfer_count": F.sum("transfers_count"),
        "replacement_count": F.count_if("replacement_issued_flag"),
        "replacement_cost_missing_count": F.count_if("replacement_cost_missing_flag"),
        "refund_ticket_count": F.count_if(F.col("refund_amount_inr") > 0),
        "refund_replacement_anomaly_count": F.count_if("refund_replacement_anomaly_flag"),
        "repeat_contact_candidate_count": F.count_if("repeat_contact_candidate_flag"),
        "known_replacement_count": F.count_if(known),
        **{f: F.coalesce(F.sum(f), money(0)) for f in SUM_FIELDS},
    }


def _finish(df: DataFrame) -> DataFrame:
    c = F.col

    def ratio(a: str, b: str) -> Column:
        return F.try_divide(c(a).cast("double"), c(b).cast("double"))

    return df.withColumns(
        {
            **{f: money(c(f)) for f in SUM_FIELDS},
            "sla_breach_rate": ratio("sla_breach_count", "sla_eligible_count"),
            "average_sla_breach_cost_per_completed_ticket_inr": ratio("sla_breach_cost_inr", "completed_ticket_count"),
            "average_replacement_cost_inr": ratio("replacement_cost_inr", "known_replacement_count"),
        }
    ).drop("known_replacement_count")


def aggregate_economics(tickets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, rates and money sums per key in one aggregation."""
    return _finish(tickets.groupBy(*keys).agg(*[m.alias(n) for n, m in economics_measures().items()]))


def period_economics(tickets: DataFrame) -> DataFrame:
    """All, month and quarter rows from one pass, with the change against the previous quarter."""
    measures = economics_measures()
    fine = tickets.groupBy("reporting_month", "reporting_quarter").agg(*[m.alias(n) for n, m in measures.items()])
    sliced = explode_periods(fine, ["all", "month", "quarter"])
    rows = _finish(sliced.groupBy(*PERIOD).agg(*[F.sum(n).alias(n) for n in measures]))
    return quarter_change(rows)


def quarter_change(periods: DataFrame, value: str = "total_relevant_exposure_inr") -> DataFrame:
    """Difference and percentage against the previous quarter; other period rows get NULLs."""
    previous = F.lag(value).over(Window.partitionBy("period_type").orderBy("period"))
    quarter = F.col("period_type") == "quarter"
    current = F.col(value)
    percent = F.try_divide(current.cast("double"), previous.cast("double")) * 100 - 100
    return periods.withColumns(
        {
            "quarter_over_quarter_change_inr": F.when(quarter, money(current - previous)),
            "quarter_over_quarter_change_pct": F.when(quarter, F.round(percent, 2)),
        }
    )


AGENT_KEYS = (*ASSIGNMENT, "comparison_group", "peer_supported")


def economics_rollups(tickets: DataFrame) -> dict[str, DataFrame]:
    """The standing rollups: period, channel, team, peer group, product, refund reason and agent."""
    return {
        "period_economics": period_economics(tickets),
        "channel_economics": aggregate_economics(tickets, ["channel"]),
        "team_economics": aggregate_economics(tickets, ["agent_team", "agent_tier"]),
        "peer_group_economics": aggregate_economics(
            tickets, ["comparison_group", "peer_fallback_level", "peer_supported"]
        ),
        "product_economics": aggregate_economics(
            tickets.filter("replacement_issued_flag"), ["product_sku", "replacement_product_family"]
        ),
        "refund_reason_economics": aggregate_economics(
            tickets.filter("refund_amount_inr > 0"), ["refund_reason_code"]
        ),
        "agent_economics": aggregate_economics(
            tickets.filter("attendance_flag and agent_id is not null"), list(AGENT_KEYS)
        ),
    }


def agent_exposure(tickets: DataFrame) -> DataFrame:
    """Exposures per agent over completed tickets: one row per agent even after a re-assignment."""
    done = tickets.filter("attendance_flag and agent_id is not null")
    return aggregate_economics(done, ["agent_id"])


def exposure_totals(tickets: DataFrame) -> DataFrame:
    """One row: every summed money column over all tickets."""
    return tickets.agg(*[money(F.coalesce(F.sum(f), F.lit(0))).alias(f) for f in SUM_FIELDS])


def claim_comparisons(
    periods: DataFrame, quarter_before: str, quarter_after: str, month_before: str, month_after: str, average_months: Sequence[str]
) -> DataFrame:
    """One row: quarter against quarter and month against month, plus a monthly average and the observed quarters."""
    kind, period = F.col("period_type"), F.col("period")

    def pick(field: str, k: str, p: str) -> Column:
        return F.max(F.when((kind == k) & (period == p), F.col(field)))

    def change(after: str, before: str) -> Column:
        a, b = F.col(after).cast("double"), F.col(before).cast("double")
        return F.round(F.try_divide(a, b) * 100 - 100, 2)

    months = (kind == "month") & period.isin(*average_months)
    facts = periods.agg(
        pick("ticket_count", "quarter", quarter_before).alias("ticket_volume_before"),
        pick("ticket_count", "quarter", quarter_after).alias("ticket_volume_after"),
        pick("replacement_count", "quarter", quarter_before).alias("replacement_count_before"),
        pick("replacement_count", "quarter", quarter_after).alias("replacement_count_after"),
        pick("replacement_exposure_inr", "month", month_before).alias("replacement_exposure_month_before"),
        pick("replacement_exposure_inr", "month", month_after).alias("replacement_exposure_month_after"),
        money(
            F.coalesce(F.sum(F.when(months, F.col("replacement_exposure_inr"))), money(0)) / len(average_months)
        ).alias("monthly_average_replacement_exposure"),
        F.max(F.when(kind == "quarter", period)).alias("latest_observed_quarter"),
        F.sort_array(F.collect_set(F.when(kind == "quarter", period))).alias("available_quarters"),
    )
    return facts.withColumns(
        {
            "ticket_volume_change_pct": change("ticket_volume_after", "ticket_volume_before"),
            "replacement_count_change_pct": change("replacement_count_after", "replacement_count_before"),
            "replacement_exposure_change_pct": change("replacement_exposure_month_after", "replacement_exposure_month_before"),
        }
    )


def opportunity_scenarios(
    totals: DataFrame, drivers: Mapping[str, str] = DRIVERS, rates: Sequence[float] = SCENARIO_RATES
) -> DataFrame:
    """(driver, rate) rows: a hypothetical reduction of each observed exposure. Negative exposures are an error."""
    cells = [
        F.struct(F.lit(d).alias("cost_driver"), F.col(c).cast(MONEY).alias("observed_exposure")) for d, c in drivers.items()
    ]
    observed = F.col("observed_exposure")
    valid = F.when(observed < 0, F.raise_error(F.concat(F.lit("negative exposure: "), F.col("cost_driver"))).cast(MONEY))
    rows = totals.select(F.inline(F.array(*cells))).withColumn("observed_exposure", valid.otherwise(observed))
    exploded = rows.withColumn("scenario_reduction_rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    share = F.col("scenario_reduction_rate").cast("decimal(6,4)")
    return exploded.withColumn("scenario_opportunity", money(F.round(F.col("observed_exposure") * share, 2)))


def scenario_totals(scenarios: DataFrame) -> DataFrame:
    """Opportunity per rate, without the repeat-contact subset that contact cost already holds."""
    return (
        scenarios.filter(F.col("cost_driver") != REPEAT_SUBSET)
        .groupBy("scenario_reduction_rate")
        .agg(money(F.sum("scenario_opportunity")).alias("scenario_opportunity_total"))
    )


def full_period_row(periods: DataFrame) -> DataFrame:
    return periods.filter(F.col("period_type") == FULL_PERIOD)
