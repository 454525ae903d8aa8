"""Ticket metrics and their summaries (over tickets derived from events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskgauge.functions import times
from deskgauge.operators import clean, metrics
from deskgauge.plans.adapters import EVENT_TICKETS_SQL, event_tickets
from deskgauge.plans.catalog import out, query, with_sql

METRICS_SQL = (
    EVENT_TICKETS_SQL
    + """,
scored AS (
  SELECT *, lower(trim(status)) IN ('resolved', 'closed') AS attendance_flag,
    CASE WHEN regexp_full_match(trim(csat_score), '[+-]?[0-9]+') THEN CAST(trim(csat_score) AS INTEGER) END AS s,
    CASE WHEN regexp_full_match(trim(transfers), '[+-]?[0-9]+') THEN CAST(trim(transfers) AS INTEGER) END AS t,
    CASE lower(channel) WHEN 'chat' THEN 15 WHEN 'voice' THEN 120 WHEN 'social' THEN 240 WHEN 'email' THEN 480 END
      AS sla_target_minutes,
    (epoch_us(resolved_at) - epoch_us(first_response_at)) / 6e7 AS hm,
    (epoch_us(first_response_at) - epoch_us(created_at)) / 6e7 AS fm
  FROM event_tickets),
ticket_metrics AS (
  SELECT *,
    CASE WHEN coalesce(csat_score, '') = '' THEN 'no_response' WHEN s IS NULL THEN 'invalid_score'
         WHEN s NOT BETWEEN 1 AND 5 THEN 'score_out_of_range' ELSE '' END AS csat_eligibility_reason,
    coalesce(s BETWEEN 1 AND 5, false) AS csat_response_flag,
    CASE WHEN s BETWEEN 1 AND 5 THEN s END AS csat_score_numeric,
    coalesce(s BETWEEN 1 AND 5, false) AND NOT attendance_flag AS csat_unexpected_status_flag,
    coalesce(s BETWEEN 1 AND 5, false) AND attendance_flag AS valid_for_csat,
    csat_score <> '' AND NOT coalesce(s BETWEEN 1 AND 5, false) AS csat_score_invalid_flag,
    CASE WHEN attendance_flag AND hm >= 0 THEN hm END AS handle_time_minutes,
    CASE WHEN first_response_at IS NULL OR resolved_at IS NULL THEN 'missing_timestamp' WHEN hm < 0 THEN 'negative_duration'
         WHEN NOT attendance_flag THEN 'not_completed' ELSE '' END AS handle_time_eligibility_reason,
    attendance_flag AND coalesce(hm >= 0, false) AS valid_for_handle_time,
    CASE WHEN fm >= 0 THEN fm END AS first_response_minutes,
    CASE WHEN first_response_at IS NULL THEN 'missing_timestamp' WHEN fm < 0 THEN 'negative_duration' ELSE '' END
      AS first_response_eligibility_reason,
    coalesce(fm >= 0, false) AS valid_for_first_response,
    CASE WHEN sla_target_minutes IS NOT NULL AND fm >= 0 THEN fm > sla_target_minutes END AS sla_breach_flag,
    CASE WHEN sla_target_minutes IS NULL OR fm IS NULL OR fm < 0 THEN 'not_evaluable'
         WHEN fm > sla_target_minutes THEN 'breached' ELSE 'met' END AS sla_status,
    CASE WHEN sla_target_minutes IS NULL THEN 'unknown_channel' WHEN first_response_at IS NULL THEN 'missing_timestamp'
         WHEN fm < 0 THEN 'negative_duration' ELSE '' END AS sla_eligibility_reason,
    sla_target_minutes IS NOT NULL AND coalesce(fm >= 0, false) AS valid_for_sla,
    CASE WHEN t >= 0 THEN t END AS transfers_numeric,
    CASE WHEN coalesce(transfers, '') = '' THEN 'missing' WHEN t IS NULL THEN 'invalid' WHEN t < 0 THEN 'negative' ELSE '' END
      AS transfer_eligibility_reason,
    coalesce(t >= 0, false) AS valid_for_transfers,
    CASE WHEN t >= 0 THEN t > 0 END AS transfer_flag,
    strftime(created_at + INTERVAL 330 MINUTE, '%Y-%m') AS reporting_month,
    year(created_at + INTERVAL 330 MINUTE) || '-Q' || quarter(created_at + INTERVAL 330 MINUTE) AS reporting_quarter
  FROM scored)"""
)


def event_metrics(spark, sf_dir):
    return metrics.ticket_metrics(event_tickets(spark, sf_dir))


def event_metrics_with_quality(spark, sf_dir):
    return clean.flag_message_quality(event_metrics(spark, sf_dir))


def _measured(name: str, keys: str = "", n: str = "", x: str = "", flags: str = ""):
    """A per-ticket query selecting some derived columns."""
    columns = ["ticket_id", *keys.split(), *n.split(), *x.split(), *flags.split()]
    sql = with_sql(METRICS_SQL, f"SELECT {out('ticket_id ' + keys, n, x, flags=flags)} FROM ticket_metrics")
    query(name, sql)(lambda spark, sf: event_metrics(spark, sf).select(*columns))


_measured("met1_attendance_flag", "status", flags="attendance_flag")
_measured("met2_csat_eligibility", "csat_score csat_eligibility_reason", "csat_score_numeric")
_measured(
    "met3_csat_flags",
    flags="csat_response_flag csat_unexpected_status_flag valid_for_csat csat_score_invalid_flag",
)
_measured("met5_handle_time", "handle_time_eligibility_reason", x="handle_time_minutes", flags="valid_for_handle_time")
_measured(
    "met6_first_response",
    "first_response_eligibility_reason",
    x="first_response_minutes",
    flags="valid_for_first_response",
)
_measured(
    "met7_sla_for_ticket",
    "channel sla_status sla_eligibility_reason",
    "sla_target_minutes",
    flags="sla_breach_flag valid_for_sla",
)
_measured(
    "met8_transfer_value",
    "transfers transfer_eligibility_reason",
    "transfers_numeric",
    flags="valid_for_transfers transfer_flag",
)
_measured(
    "met9_derive_ticket_metrics",
    "csat_eligibility_reason handle_time_eligibility_reason sla_status reporting_month",
    "csat_score_numeric transfers_numeric sla_target_minutes",
    "handle_time_minutes first_response_minutes",
    "attendance_flag valid_for_csat valid_for_handle_time valid_for_sla sla_breach_flag transfer_flag",
)
_measured("met10_periods", "reporting_month reporting_quarter")


@query(
    "met4_elapsed_minutes",
    with_sql(
        EVENT_TICKETS_SQL,
        """SELECT ticket_id,
             CASE WHEN resolved_at >= created_at THEN round((epoch_us(resolved_at) - epoch_us(created_at)) / 6e7, 6) END
               AS minutes,
             CASE WHEN resolved_at IS NULL THEN 'missing_timestamp' WHEN resolved_at < created_at THEN 'negative_duration'
                  ELSE '' END AS reason
           FROM event_tickets""",
    ),
)
def _elapsed(spark, sf):
    t = event_tickets(spark, sf)
    return t.select("ticket_id", times.elapsed(t, "created_at", "resolved_at").alias("e")).select("ticket_id", "e.*")


# --- summaries ----------------------------------------------------------------------------------------------------
_ATTENDANCE = (
    "ticket_count completed_ticket_count resolved_ticket_count closed_ticket_count open_pending_ticket_count "
    "attendance_ineligible_status_count"
)
_CSAT = (
    "csat_response_count csat_completed_response_count csat_populated_valid_score_count "
    "csat_response_on_noncompleted_count csat_score_1_count csat_score_2_count csat_score_3_count csat_score_4_count "
    "csat_score_5_count csat_invalid_score_count"
)
_HANDLE = "handle_time_eligible_count handle_time_ineligible_count"
_HANDLE_X = "handle_time_mean handle_time_median handle_time_p75 handle_time_p90"
_FIRST = "first_response_eligible_count first_response_ineligible_count"
_FIRST_X = "first_response_mean first_response_median"
_SLA = "sla_eligible_count sla_ineligible_count sla_breach_count sla_met_count"
_TRANSFER = (
    "transfer_valid_count transfer_ineligible_count total_transfers transfer_count transferred_ticket_count "
    "completed_ticket_transfer_valid_count"
)
_TRANSFER_X = "transfer_rate transferred_ticket_rate average_transfers_per_ticket transfers_per_completed_ticket"
_QUALITY = (
    "text_degraded_ticket_count signup_anomaly_ticket_count product_prelaunch_ticket_count "
    "reconciliation_candidate_count unmatched_roster_ticket_count"
)
_WIDE_N = f"{_ATTENDANCE} {_CSAT} {_HANDLE} {_FIRST} {_SLA} {_TRANSFER}"
_WIDE_X = f"csat_response_rate mean_csat {_HANDLE_X} {_FIRST_X} sla_breach_rate {_TRANSFER_X}"


def summary_sql(keys: str) -> str:
    """Select list of the wide summary row."""
    status = "lower(trim(status))"
    return f"""{keys + ',' if keys else ''} count(*) AS ticket_count,
      count_if(attendance_flag) AS completed_ticket_count, count_if({status} = 'resolved') AS resolved_ticket_count,
      count_if({status} = 'closed') AS closed_ticket_count,
      count_if({status} IN ('open', 'pending')) AS open_pending_ticket_count,
      count_if({status} NOT IN ('resolved', 'closed', 'open', 'pending')) AS attendance_ineligible_status_count,
      count_if(valid_for_csat) AS csat_response_count,
      count_if(valid_for_csat AND attendance_flag) AS csat_completed_response_count,
      count_if(csat_response_flag) AS csat_populated_valid_score_count,
      count_if(csat_unexpected_status_flag) AS csat_response_on_noncompleted_count,
      {', '.join(f"count_if(valid_for_csat AND csat_score_numeric = {i}) AS csat_score_{i}_count" for i in range(1, 6))},
      count_if(csat_eligibility_reason IN ('invalid_score', 'score_out_of_range')) AS csat_invalid_score_count,
      count_if(valid_for_csat AND attendance_flag) / nullif(count_if(attendance_flag), 0) AS csat_response_rate,
      avg(csat_score_numeric) FILTER (WHERE valid_for_csat) AS mean_csat,
      count_if(valid_for_handle_time) AS handle_time_eligible_count,
      count(*) - count_if(valid_for_handle_time) AS handle_time_ineligible_count,
      avg(handle_time_minutes) AS handle_time_mean, quantile_cont(handle_time_minutes, 0.5) AS handle_time_median,
      quantile_cont(handle_time_minutes, 0.75) AS handle_time_p75, quantile_cont(handle_time_minutes, 0.9) AS handle_time_p90,
      count_if(valid_for_first_response) AS first_response_eligible_count,
      count(*) - count_if(valid_for_first_response) AS first_response_ineligible_count,
      avg(first_response_minutes) AS first_response_mean,
      quantile_cont(first_response_minutes, 0.5) AS first_response_median,
      count_if(valid_for_sla) AS sla_eligible_count, count(*) - count_if(valid_for_sla) AS sla_ineligible_count,
      count_if(sla_status = 'breached') AS sla_breach_count, count_if(sla_status = 'met') AS sla_met_count,
      count_if(sla_status = 'breached') / nullif(count_if(valid_for_sla), 0) AS sla_breach_rate,
      count_if(valid_for_transfers) AS transfer_valid_count,
      count(*) - count_if(valid_for_transfers) AS transfer_ineligible_count,
      coalesce(sum(transfers_numeric), 0) AS total_transfers, coalesce(sum(transfers_numeric), 0) AS transfer_count,
      count_if(transfers_numeric > 0) AS transferred_ticket_count,
      count_if(transfers_numeric > 0) / nullif(count_if(valid_for_transfers), 0) AS transfer_rate,
      count_if(transfers_numeric > 0) / nullif(count_if(valid_for_transfers), 0) AS transferred_ticket_rate,
      avg(transfers_numeric) AS average_transfers_per_ticket,
      count_if(attendance_flag AND valid_for_transfers) AS completed_ticket_transfer_valid_count,
      avg(transfers_numeric) FILTER (WHERE attendance_flag) AS transfers_per_completed_ticket"""


def _summary(name: str, build, keys: str = "", n: str = _WIDE_N, x: str = _WIDE_X, grouping: str = ""):
    sql = with_sql(
        f"{METRICS_SQL}, g AS (SELECT {summary_sql(', '.join(keys.split()))} FROM ticket_metrics {grouping})",
        f"SELECT {out(keys, n, x)} FROM g",
    )
    columns = [*keys.split(), *n.split(), *x.split()]
    query(name, sql)(lambda spark, sf: build(event_metrics(spark, sf)).select(*columns))


_summary("agg1_attendance_summary", lambda df: metrics.summarize_family(df, "attendance"), "", _ATTENDANCE, "")
_summary(
    "agg2_csat_summary",
    lambda df: metrics.summarize_family(df, "csat", ["channel"]),
    "channel",
    f"ticket_count completed_ticket_count {_CSAT}",
    "csat_response_rate mean_csat",
    "GROUP BY channel",
)
_summary(
    "agg3_duration_summary",
    lambda df: metrics.duration_summary(df, ["category"], "handle_time_minutes", "valid_for_handle_time", "handle_time"),
    "category",
    _HANDLE,
    _HANDLE_X,
    "GROUP BY category",
)
_summary(
    "agg4_first_response_summary",
    lambda df: metrics.duration_summary(
        df, ["channel"], "first_response_minutes", "valid_for_first_response", "first_response"
    ),
    "channel",
    _FIRST,
    _FIRST_X,
    "GROUP BY channel",
)
_summary(
    "agg5_sla_summary",
    lambda df: metrics.summarize_family(df, "sla", ["channel"]),
    "channel",
    _SLA,
    "sla_breach_rate",
    "GROUP BY channel",
)
_summary(
    "agg6_transfer_summary",
    lambda df: metrics.summarize_family(df, "transfer", ["agent_id"]),
    "agent_id",
    _TRANSFER,
    _TRANSFER_X,
    "GROUP BY agent_id",
)
_summary("agg7_summarize", lambda df: metrics.summarize(df))
_summary("agg8_agent_metrics", metrics.agent_metrics, "agent_id", grouping="GROUP BY agent_id")
_summary(
    "agg11_channel_metrics", lambda df: metrics.summarize(df, ["channel"]), "channel", grouping="GROUP BY channel"
)
_summary(
    "agg11_team_metrics",
    lambda df: metrics.summarize(df, ["agent_team", "agent_tier"]),
    "agent_team agent_tier",
    grouping="GROUP BY agent_team, agent_tier",
)

_PERIODS_SQL = (
    METRICS_SQL
    + f""",
sliced AS (
  SELECT *, 'full_available_period' AS period_type, 'all' AS period FROM ticket_metrics
  UNION ALL SELECT *, 'month', reporting_month FROM ticket_metrics
  UNION ALL SELECT *, 'quarter', reporting_quarter FROM ticket_metrics),
g AS (SELECT {summary_sql('period_type, period')} FROM sliced GROUP BY period_type, period)"""
)


@query("agg10_period_metrics", with_sql(_PERIODS_SQL, f"SELECT {out('period_type period', _WIDE_N, _WIDE_X)} FROM g"))
def _period_metrics(spark, sf):
    wide = metrics.period_metrics(event_metrics(spark, sf))
    return wide.select("period_type", "period", *_WIDE_N.split(), *_WIDE_X.split())


@query(
    "agg15_handle_time_by_source",
    with_sql(
        METRICS_SQL,
        """SELECT source_system, count(handle_time_minutes) AS eligible_count,
             count_if(handle_time_minutes > 1440) AS over_24_hours, count_if(handle_time_minutes > 10080) AS over_7_days,
             round(avg(handle_time_minutes), 6) AS mean_minutes,
             round(quantile_cont(handle_time_minutes, 0.5), 6) AS median_minutes,
             round(max(handle_time_minutes), 6) AS maximum_minutes
           FROM ticket_metrics GROUP BY source_system""",
    ),
)
def _by_source(spark, sf):
    return metrics.handle_time_by_source(event_metrics(spark, sf))


_INVARIANTS_SQL = with_sql(
    f"{METRICS_SQL}, g AS (SELECT {summary_sql('')} FROM ticket_metrics)",
    """SELECT name, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM (
         SELECT unnest(['ticket_row_reconciliation', 'attendance_reconciliation', 'csat_denominator', 'metric_eligibility',
                        'rate_and_score_bounds', 'ticket_output_count']) AS name,
                unnest([ticket_count = completed_ticket_count + open_pending_ticket_count + attendance_ineligible_status_count,
                        completed_ticket_count = resolved_ticket_count + closed_ticket_count,
                        csat_response_count <= completed_ticket_count,
                        sla_eligible_count <= first_response_eligible_count AND handle_time_eligible_count <= ticket_count,
                        csat_response_rate BETWEEN 0 AND 1 AND sla_breach_rate BETWEEN 0 AND 1
                          AND transfer_rate BETWEEN 0 AND 1 AND mean_csat BETWEEN 1 AND 5,
                        ticket_count >= 0]) AS ok FROM g)""",
)


@query("val10_metric_invariants", _INVARIANTS_SQL)
def _invariants(spark, sf):
    return metrics.metric_invariants(metrics.summarize(event_metrics(spark, sf)))


@query(
    "agg7_quality_counts",
    with_sql(
        METRICS_SQL,
        """SELECT agent_tier, count(*) AS ticket_count,
             count_if(customer_message = '') AS text_degraded_ticket_count FROM ticket_metrics GROUP BY agent_tier""",
    ),
)
def _quality_counts(spark, sf):
    wide = metrics.summarize(event_metrics_with_quality(spark, sf), ["agent_tier"])
    return wide.select("agent_tier", "ticket_count", "text_degraded_ticket_count")
