"""Per-ticket eligibility and metrics, and their grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskgauge.functions.keys import PERIOD, explode_periods, join_null_safe
from deskgauge.functions.times import elapsed, with_periods
from deskgauge.operators.order_stats import long_counts, percentiles_of_counts
from deskgauge.params import ASSIGNMENT, COMPLETED_STATUSES, OPEN_STATUSES, ServicePolicy


# --- per-ticket expressions ---------------------------------------------------------------------------------------
def _folded(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def is_completed(status: Column) -> Column:
    return _folded(status).isin(*COMPLETED_STATUSES)


def score_eligibility(raw: Column) -> Column:
    """``struct(ok, score, reason)``: an integer from 1 to 5 is a score, anything else names its reason."""
    text = F.nullif(raw.cast("string"), F.lit(""))
    score = F.trim(text).try_cast("int")
    reason = (
        F.when(text.isNull(), "no_response")
        .when(score.isNull(), "invalid_score")
        .when(~score.between(1, 5), "score_out_of_range")
        .otherwise("")
    )
    ok = reason == ""
    return F.struct(ok.alias("ok"), F.when(ok, score).alias("score"), reason.alias("reason"))


def transfer_eligibility(raw: Column) -> Column:
    """``struct(value, reason)``: a non-negative integer, else the reason."""
    text = F.nullif(raw.cast("string"), F.lit(""))
    value = F.trim(text).try_cast("int")
    reason = (
        F.when(text.isNull(), "missing").when(value.isNull(), "invalid").when(value < 0, "negative").otherwise("")
    )
    return F.struct(F.when(reason == "", value).alias("value"), reason.alias("reason"))


def sla_target(channel: Column, targets: dict) -> Column:
    lookup = F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, int(v))])
    return F.try_element_at(lookup, F.lower(F.coalesce(channel, F.lit(""))))


def derive_ticket_metrics(df: DataFrame, policy: ServicePolicy = ServicePolicy()) -> DataFrame:
    """Eligibility flags, reasons and metric values per ticket. The grain is kept; the plan stays one projection."""
    completed = is_completed(F.col("status"))
    staged = df.withColumns(
        {
            "attendance_flag": completed,
            "__score": score_eligibility(F.col("csat_score")),
            "__handle": elapsed(df, "first_response_at", "resolved_at"),
            "__first": elapsed(df, "created_at", "first_response_at"),
            "__transfer": transfer_eligibility(F.col("transfers")),
            "sla_target_minutes": sla_target(F.col("channel"), policy.sla_targets),
        }
    )
    done = F.col("attendance_flag")
    handled = F.col("__handle.minutes").isNotNull()
    first = F.col("__first.minutes")
    evaluable = F.col("sla_target_minutes").isNotNull() & first.isNotNull()
    breach = F.when(evaluable, first > F.col("sla_target_minutes"))
    return staged.withColumns(
        {
            "valid_for_attendance": done,
            "csat_score_numeric": F.col("__score.score"),
            "csat_eligibility_reason": F.col("__score.reason"),
            "csat_response_flag": F.col("__score.ok"),
            "csat_unexpected_status_flag": F.col("__score.ok") & ~done,
            "valid_for_csat": F.col("__score.ok") & done,
            "csat_score_invalid_flag": ~F.col("__score.reason").isin("", "no_response"),
            "handle_time_minutes": F.when(done, F.col("__handle.minutes")),
            "handle_time_eligibility_reason": F.when(handled & ~done, "not_completed").otherwise(
                F.col("__handle.reason")
            ),
            "valid_for_handle_time": handled & done,
            "first_response_minutes": first,
            "first_response_eligibility_reason": F.col("__first.reason"),
            "valid_for_first_response": first.isNotNull(),
            "sla_breach_flag": breach,
            "sla_status": F.when(breach, "breached").when(~breach, "met").otherwise("not_evaluable"),
            "sla_eligibility_reason": F.when(F.col("sla_target_minutes").isNull(), "unknown_channel").otherwise(
                F.col("__first.reason")
            ),
            "valid_for_sla": evaluable,
            "transfers_numeric": F.col("__transfer.value"),
            "transfer_eligibility_reason": F.col("__transfer.reason"),
            "valid_for_transfers": F.col("__transfer.value").isNotNull(),
            "transfer_flag": F.col("__transfer.value") > 0,
        }
    ).drop("__score", "__handle", "__first", "__transfer")


def ticket_metrics(df: DataFrame, policy: ServicePolicy = ServicePolicy()) -> DataFrame:
    """Derived metrics plus reporting month and quarter."""
    return with_periods(derive_ticket_metrics(df, policy), zone=policy.zone)


# --- additive measures and what is derived from them --------------------------------------------------------------
def attendance_measures() -> dict[str, Column]:
    status = _folded(F.col("status"))
    return {
        "ticket_count": F.count(F.lit(1)),
        "completed_ticket_count": F.count_if("attendance_flag"),
        "resolved_ticket_count": F.count_if(status == "resolved"),
        "closed_ticket_count": F.count_if(status == "closed"),
        "open_pending_ticket_count": F.count_if(status.isin(*OPEN_STATUSES)),
        "attendance_ineligible_status_count": F.count_if(~status.isin(*COMPLETED_STATUSES, *OPEN_STATUSES)),
    }


def csat_measures() -> dict[str, Column]:
    valid, score = F.col("valid_for_csat"), F.col("csat_score_numeric")
    return {
        "csat_response_count": F.count_if(valid),
        "csat_completed_response_count": F.count_if(valid & F.col("attendance_flag")),
        "csat_populated_valid_score_count": F.count_if("csat_response_flag"),
        "csat_score_sum": F.sum(F.when(valid, score)),
        "csat_response_on_noncompleted_count": F.count_if("csat_unexpected_status_flag"),
        **{f"csat_score_{s}_count": F.count_if(valid & (score == s)) for s in range(1, 6)},
        "csat_invalid_score_count": F.count_if(
            F.col("csat_eligibility_reason").isin("invalid_score", "score_out_of_range")
        ),
    }


def duration_measures() -> dict[str, Column]:
    valid, minutes = F.col("valid_for_handle_time"), F.col("handle_time_minutes")
    return {
        "handle_time_eligible_count": F.count_if(valid & minutes.isNotNull()),
        "handle_time_sum": F.sum(F.when(valid, minutes)),
        "first_response_eligible_count": F.count_if("valid_for_first_response"),
        "first_response_sum": F.sum(F.when(F.col("valid_for_first_response"), F.col("first_response_minutes"))),
    }


def sla_measures() -> dict[str, Column]:
    return {
        "sla_eligible_count": F.count_if(F.col("sla_status").isin("met", "breached")),
        "sla_breach_count": F.count_if(F.col("sla_status") == "breached"),
    }


def transfer_measures() -> dict[str, Column]:
    valid, value = F.col("valid_for_transfers"), F.col("transfers_numeric")
    done = F.col("attendance_flag")
    return {
        "transfer_valid_count": F.count_if(valid),
        "total_transfers": F.coalesce(F.sum(F.when(valid, value)), F.lit(0)),
        "transferred_ticket_count": F.count_if(valid & (value > 0)),
        "completed_ticket_transfer_valid_count": F.count_if(done & valid),
        "completed_transfer_sum": F.coalesce(F.sum(F.when(done & valid, value)), F.lit(0)),
    }


def quality_measures() -> dict[str, Column]:
    return {
        "text_degraded_ticket_count": F.count_if(F.col("text_quality_flag") == "degraded"),
        "signup_anomaly_ticket_count": F.count_if("signup_anomaly_flag"),
        "product_prelaunch_ticket_count": F.count_if("product_prelaunch_anomaly_flag"),
        "reconciliation_candidate_count": F.count_if("reconciliation_flag"),
        "unmatched_roster_ticket_count": F.count_if(~F.col("agent_assignment_flag").eqNullSafe("matched")),
    }


QUALITY_FLAGS = {
    "text_quality_flag": "string",
    "signup_anomaly_flag": "boolean",
    "product_prelaunch_anomaly_flag": "boolean",
    "reconciliation_flag": "boolean",
    "agent_assignment_flag": "string",
}


def all_measures() -> dict[str, Column]:
    return {
        **attendance_measures(),
        **csat_measures(),
        **duration_measures(),
        **sla_measures(),
        **transfer_measures(),
        **quality_measures(),
    }


def _finish(df: DataFrame) -> DataFrame:
    """Rates and means from the additive columns."""
    c = F.col

    def share(part: str, whole: str) -> Column:
        return F.try_divide(c(part), c(whole))

    return df.withColumns(
        {
            "csat_response_rate": share("csat_completed_response_count", "completed_ticket_count"),
            "mean_csat": share("csat_score_sum", "csat_response_count"),
            "handle_time_ineligible_count": c("ticket_count") - c("handle_time_eligible_count"),
            "handle_time_mean": share("handle_time_sum", "handle_time_eligible_count"),
            "first_response_ineligible_count": c("ticket_count") - c("first_response_eligible_count"),
            "first_response_mean": share("first_response_sum", "first_response_eligible_count"),
            "sla_ineligible_count": c("ticket_count") - c("sla_eligible_count"),
            "sla_met_count": c("sla_eligible_count") - c("sla_breach_count"),
            "sla_breach_rate": share("sla_breach_count", "sla_eligible_count"),
            "transfer_ineligible_count": c("ticket_count") - c("transfer_valid_count"),
            "transfer_count": c("total_transfers"),
            "transfer_rate": share("transferred_ticket_count", "transfer_valid_count"),
            "transferred_ticket_rate": share("transferred_ticket_count", "transfer_valid_count"),
            "average_transfers_per_ticket": share("total_transfers", "transfer_valid_count"),
            "transfers_per_completed_ticket": share("completed_transfer_sum", "completed_ticket_transfer_valid_count"),
        }
    ).drop("csat_score_sum", "handle_time_sum", "first_response_sum", "completed_transfer_sum")


PERCENTILES = {
    "handle": {"handle_time_median": 0.5, "handle_time_p75": 0.75, "handle_time_p90": 0.9},
    "first": {"first_response_median": 0.5},
}


def summarize(df: DataFrame, keys: Sequence[str] = (), slices: Sequence[str] = ()) -> DataFrame:
    """One wide metric row per key, optionally per period slice.

    Facts are aggregated once at (keys, month, quarter); coarser slices are rolled up from those partials, so asking
    for all, quarter and month at once does not multiply the facts.
    """
    missing = {n: F.lit(None).cast(t) for n, t in QUALITY_FLAGS.items() if n not in df.columns}
    df = df.withColumns(missing) if missing else df
    keys = list(keys)
    fine = [*keys, "reporting_month", "reporting_quarter"] if slices else (keys or ["__all"])
    if not slices and not keys:
        df = df.withColumn("__all", F.lit(1))
    measures = all_measures()
    partial = df.groupBy(*fine).agg(*[m.alias(n) for n, m in measures.items()])
    counts = long_counts(
        df.withColumns(
            {
                "__h": F.when(F.col("valid_for_handle_time"), F.col("handle_time_minutes")),
                "__f": F.when(F.col("valid_for_first_response"), F.col("first_response_minutes")),
            }
        ),
        fine,
        {"handle": "__h", "first": "__f"},
    )
    group = fine
    if slices:
        group = [*keys, *PERIOD]
        partial = explode_periods(partial, slices).groupBy(*group).agg(*[F.sum(n).alias(n) for n in measures])
        counts = explode_periods(counts, slices).groupBy(*group, "measure", "value").agg(F.sum("cnt").alias("cnt"))
    quantiles = percentiles_of_counts(counts, group, PERCENTILES)
    return _finish(_beside(partial, quantiles, group))


def _beside(rows: DataFrame, extra: DataFrame, group: Sequence[str]) -> DataFrame:
    """Attach per-key columns; a keyless result is one row, so its columns come as scalar subqueries."""
    if list(group) != ["__all"]:
        return join_null_safe(rows, extra, group)
    added = {c: extra.select(c).scalar() for c in extra.columns if c != "__all"}
    return rows.withColumns(added).drop("__all")


# --- summaries of one family, for callers that need only part of the wide row -------------------------------------
FAMILIES = {
    "attendance": (
        attendance_measures,
        (),
    ),
    "csat": (csat_measures, ("csat_response_rate", "mean_csat")),
    "sla": (sla_measures, ("sla_ineligible_count", "sla_met_count", "sla_breach_rate")),
    "transfer": (
        transfer_measures,
        (
            "transfer_ineligible_count",
            "transfer_count",
            "transfer_rate",
            "transferred_ticket_rate",
            "average_transfers_per_ticket",
            "transfers_per_completed_ticket",
        ),
    ),
}


def summarize_family(df: DataFrame, family: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and rates of one metric family: a single aggregation without percentiles."""
    measures, derived = FAMILIES[family]
    base = {**attendance_measures(), **csat_measures(), **duration_measures(), **sla_measures(), **transfer_measures()}
    wide = _finish(df.groupBy(*keys).agg(*[m.alias(n) for n, m in base.items()]))
    own = [n for n in measures() if n in wide.columns]
    return wide.select(*dict.fromkeys([*keys, "ticket_count", "completed_ticket_count", *own, *derived]))


def duration_summary(df: DataFrame, keys: Sequence[str], value: str, eligible: str, prefix: str) -> DataFrame:
    """Eligible count, mean, median, p75 and p90 of one duration column."""
    keys = list(keys)
    group = keys or ["__all"]
    df = df.withColumn("__v", F.when(F.col(eligible), F.col(value)))
    df = df if keys else df.withColumn("__all", F.lit(1))
    base = df.groupBy(*group).agg(
        F.count("__v").alias(f"{prefix}_eligible_count"),
        (F.count(F.lit(1)) - F.count("__v")).alias(f"{prefix}_ineligible_count"),
        F.avg("__v").alias(f"{prefix}_mean"),
    )
    names = {f"{prefix}_median": 0.5, f"{prefix}_p75": 0.75, f"{prefix}_p90": 0.9}
    spread = percentiles_of_counts(long_counts(df, group, {"v": "__v"}), group, {"v": names})
    return _beside(base, spread, group)


def handle_time_by_source(df: DataFrame) -> DataFrame:
    """Distribution of handle time per source system: counts over a day and a week, mean, median, maximum."""
    df = df.select(
        F.coalesce(F.nullif(F.col("source_system"), F.lit("")), F.lit("(missing)")).alias("source_system"),
        F.when(F.col("valid_for_handle_time"), F.col("handle_time_minutes")).alias("minutes"),
    )
    keys = ["source_system"]
    base = df.groupBy(*keys).agg(
        F.count("minutes").alias("eligible_count"),
        F.count_if(F.col("minutes") > 1440).alias("over_24_hours"),
        F.count_if(F.col("minutes") > 10080).alias("over_7_days"),
        F.avg("minutes").alias("mean_minutes"),
        F.max("minutes").alias("maximum_minutes"),
    )
    middle = percentiles_of_counts(long_counts(df, keys, {"m": "minutes"}), keys, {"m": {"median_minutes": 0.5}})
    return join_null_safe(base, middle, keys)


def agent_metrics(df: DataFrame) -> DataFrame:
    return summarize(df, ["agent_id"])


def assignment_metrics(df: DataFrame) -> DataFrame:
    """Per effective-dated assignment: the full period and each month."""
    rows = summarize(df, ["agent_assignment_flag", *ASSIGNMENT], ["all", "month"])
    return rows.withColumn("reporting_month", F.when(F.col("period_type") == "month", F.col("period")))


def period_metrics(df: DataFrame) -> DataFrame:
    return summarize(df, (), ["all", "month", "quarter"])


# --- invariants ---------------------------------------------------------------------------------------------------
def metric_invariants(overall: DataFrame) -> DataFrame:
    """Named PASS/FAIL checks over a one-row overall summary."""
    c = F.col

    def unit(name: str) -> Column:
        return c(name).isNull() | c(name).between(0, 1)

    rules = {
        "ticket_row_reconciliation": c("ticket_count")
        == c("completed_ticket_count") + c("open_pending_ticket_count") + c("attendance_ineligible_status_count"),
        "attendance_reconciliation": c("completed_ticket_count")
        == c("resolved_ticket_count") + c("closed_ticket_count"),
        "csat_denominator": c("csat_response_count") <= c("completed_ticket_count"),
        "metric_eligibility": (c("sla_eligible_count") <= c("first_response_eligible_count"))
        & (c("handle_time_eligible_count") <= c("ticket_count")),
        "rate_and_score_bounds": unit("csat_response_rate")
        & unit("sla_breach_rate")
        & unit("transfer_rate")
        & (c("mean_csat").isNull() | c("mean_csat").between(1, 5)),
        "ticket_output_count": c("ticket_count") >= 0,
    }
    checks = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.when(ok, "PASS").otherwise("FAIL").alias("status"))
            for n, ok in rules.items()
        ]
    )
    return overall.select(F.inline(checks))
