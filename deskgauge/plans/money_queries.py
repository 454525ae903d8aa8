"""Joins, economics and product analysis (over tickets derived from orders and events)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deskgauge.operators import clean, economics, link, metrics, peers, products, validate
from deskgauge.params import ASSIGNMENT, ServicePolicy
from deskgauge.plans.adapters import (
    EVENT_TICKETS_SQL,
    ORDER_TICKETS_SQL,
    ROSTER_SQL,
    WORK_ITEMS_SQL,
    event_tickets,
    order_dimension,
    order_tickets,
    product_dimension,
    supplier_roster,
    table,
    work_items,
)
from deskgauge.plans.catalog import out, query, staged, with_sql
from deskgauge.plans.metric_queries import METRICS_SQL, event_metrics
from deskgauge.plans.peer_queries import GROUPED_ITEMS_SQL
from deskgauge.plans.quality_queries import LINKED_SQL

# --- joins --------------------------------------------------------------------------------------------------------
@query(
    "jn1_validated_left_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, p_name AS part_p_name, p_brand AS part_p_brand, round(p_retailprice, 6) + 0.0
         AS part_p_retailprice FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
)
def _guarded(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    return link.guarded_left_join(lines, part, "l_partkey", "p_partkey", "part_")[0]


@query(
    "jn1_join_checks",
    """SELECT CAST(0 AS BIGINT) AS duplicate_dimension_keys, count(*) AS orphan_rows,
         CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
       FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _guarded_checks(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels")
    return link.guarded_left_join(docs, labels, "doc_id", "doc_id", "label_")[1]


@query(
    "jn2_assign_roster",
    with_sql(
        WORK_ITEMS_SQL,
        """SELECT ticket_id, agent_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, agent_team, agent_tier, agent_site,
             agent_shift, strftime(agent_from_date, '%Y-%m-%d') AS agent_from_date,
             strftime(agent_to_date, '%Y-%m-%d') AS agent_to_date FROM work_items""",
    ),
)
def _roster(spark, sf):
    return work_items(spark, sf).select(
        "ticket_id", "agent_id", "created_at", "agent_team", "agent_tier", "agent_site", "agent_shift", "agent_from_date",
        "agent_to_date",
    )


@query(
    "jn2b_roster_match_label",
    with_sql(
        f"{ROSTER_SQL}, {EVENT_TICKETS_SQL}",
        """, t AS (SELECT *, 'S' || substr(agent_id, 2) AS a, created_at - INTERVAL 9500 DAY AS day FROM event_tickets)
           SELECT ticket_id, CASE WHEN count(r.agent_id) = 1 THEN 'matched' WHEN count(r.agent_id) > 1 THEN 'overlapping_roster'
               WHEN any_value(t.resolved_at) IS NULL THEN 'missing_agent_or_time' ELSE 'no_roster_interval' END
               AS agent_assignment_flag, count(r.agent_id) AS roster_match_count
           FROM t LEFT JOIN (SELECT * FROM roster UNION ALL SELECT agent_id, name, site, team, tier, DATE '1998-01-10',
               DATE '1998-01-12', shift FROM roster WHERE to_date IS NULL) r ON r.agent_id = t.a
             AND CAST(t.resolved_at - INTERVAL 9500 DAY AS DATE) >= r.from_date
             AND (r.to_date IS NULL OR CAST(t.resolved_at - INTERVAL 9500 DAY AS DATE) <= r.to_date)
           GROUP BY ticket_id""",
    ),
)
def _roster_label(spark, sf):
    tickets = event_tickets(spark, sf).select(
        "ticket_id",
        F.concat(F.lit("S"), F.substring("agent_id", 2, 10)).alias("agent_id"),
        (F.col("resolved_at") - F.expr("INTERVAL 9500 DAYS")).alias("resolved_at"),
    )
    roster = supplier_roster(spark, sf)
    # a second, overlapping interval per agent makes some tickets ambiguous
    extra = roster.filter("to_date is null").withColumns(
        {"from_date": F.lit("1998-01-10").cast("date"), "to_date": F.lit("1998-01-12").cast("date")}
    )
    labelled = link.assign_roster(tickets, roster.unionByName(extra))
    return labelled.select("ticket_id", "agent_assignment_flag", "roster_match_count")


@query("jn3_order_link_basic", with_sql(LINKED_SQL, "SELECT ticket_id, linked_order_id, order_match_flag FROM linked"))
def _basic(spark, sf):
    rows = link.link_orders_basic(order_tickets(spark, sf), order_dimension(spark, sf))
    return rows.select("ticket_id", "linked_order_id", "order_match_flag")


CHECKED_SQL = (
    ORDER_TICKETS_SQL
    + """,
pairs AS (SELECT customer_id, sku, count(*) AS n, min(order_id) AS order_id FROM order_dim GROUP BY customer_id, sku),
evidence AS (
  SELECT t.*, d.order_id IS NOT NULL AS found,
    (t.customer_id IS NULL OR t.customer_id = d.customer_id) AND (t.product_sku IS NULL OR t.product_sku = d.sku) AS agrees,
    p.n AS pair_n, CASE WHEN d.order_id IS NOT NULL THEN d.order_id ELSE p.order_id END AS candidate
  FROM order_tickets t LEFT JOIN order_dim d ON t.order_id = d.order_id
  LEFT JOIN pairs p ON d.order_id IS NULL AND t.customer_id = p.customer_id AND t.product_sku = p.sku),
checked AS (
  SELECT * EXCLUDE (order_id), order_id AS source_order_id,
    CASE WHEN found AND agrees THEN 'direct_order_id' WHEN found THEN 'conflicting_direct_order_id'
         WHEN pair_n = 1 THEN 'unique_customer_sku' WHEN pair_n > 1 THEN 'multiple_customer_sku_orders' END AS order_match_method,
    CASE WHEN (found AND agrees) OR (NOT found AND pair_n = 1) THEN 'matched' WHEN found OR pair_n > 1 THEN 'ambiguous'
         ELSE 'unmatched' END AS order_match_status,
    CASE WHEN (found AND agrees) OR (NOT found AND pair_n = 1) THEN candidate END AS order_id FROM evidence),
linked_orders AS (
  SELECT c.*, o.channel AS order_channel, o.lot_code AS order_lot_code, o.order_date, o.qty AS order_quantity,
    o.order_value_inr FROM checked c LEFT JOIN order_dim o ON c.order_id = o.order_id)"""
)


@query(
    "jn4_enrich_tickets_with_orders",
    with_sql(
        CHECKED_SQL,
        f"""SELECT {out('ticket_id source_order_id order_id order_match_status order_match_method order_channel order_lot_code',
            'order_quantity', money='order_value_inr')} FROM linked_orders""",
    ),
)
def _checked(spark, sf):
    return link.link_orders_checked(order_tickets(spark, sf), order_dimension(spark, sf)).select(
        "ticket_id", "source_order_id", "order_id", "order_match_status", "order_match_method", "order_channel",
        "order_lot_code", "order_quantity", "order_value_inr",
    )


@query(
    "jn5_product_family",
    with_sql(
        ORDER_TICKETS_SQL,
        "SELECT ticket_id, product_sku, family AS product_family FROM order_tickets LEFT JOIN products ON product_sku = sku",
    ),
)
def _family(spark, sf):
    rows = link.add_product_family(order_tickets(spark, sf), product_dimension(spark, sf))
    return rows.select("ticket_id", "product_sku", "product_family")


@query(
    "jn6_attach_peer_groups",
    with_sql(
        GROUPED_ITEMS_SQL,
        "SELECT ticket_id, agent_id, comparison_group, peer_fallback_level, peer_agent_count, peer_supported FROM items",
    ),
)
def _attach(spark, sf):
    groups = peers.build_peer_groups(supplier_roster(spark, sf))
    return link.attach_peer_groups(work_items(spark, sf), groups).select(
        "ticket_id", "agent_id", "comparison_group", "peer_fallback_level", "peer_agent_count", "peer_supported"
    )


REPEAT_SQL = """
keyed AS (
  SELECT *, CASE WHEN coalesce(order_id, '') <> '' THEN 'customer_order_id'
      WHEN coalesce(product_sku, '') <> '' THEN 'customer_product_sku_fallback' END AS method,
    coalesce(nullif(order_id, ''), nullif(product_sku, '')) AS k FROM {source}),
best AS (
  SELECT c.ticket_id, max_by(p.ticket_id, (p.resolved_at, p.ticket_id)) AS prior
  FROM keyed c JOIN keyed p ON c.customer_id = p.customer_id AND c.method = p.method AND c.k = p.k
    AND p.ticket_id <> c.ticket_id AND p.resolved_at < c.created_at
  GROUP BY c.ticket_id),
repeat_contacts AS (
  SELECT c.*, coalesce(c.created_at - p.resolved_at <= INTERVAL {days} DAY, false) AS repeat_contact_candidate_flag,
    CASE WHEN c.created_at - p.resolved_at <= INTERVAL {days} DAY THEN b.prior END AS repeat_contact_prior_ticket_id,
    CASE WHEN c.created_at - p.resolved_at <= INTERVAL {days} DAY THEN c.method END AS repeat_contact_match_method,
    CASE WHEN c.method IS NULL THEN 'missing_order_and_product_sku'
         WHEN c.created_at - p.resolved_at <= INTERVAL {days} DAY THEN 'same_customer_issue_proxy_within_{days}_days'
         ELSE 'no_qualifying_prior_contact' END AS repeat_contact_candidate_reason
  FROM keyed c LEFT JOIN best b ON c.ticket_id = b.ticket_id LEFT JOIN keyed p ON b.prior = p.ticket_id)"""
_REPEAT = (
    "ticket_id repeat_contact_candidate_flag repeat_contact_prior_ticket_id repeat_contact_match_method "
    "repeat_contact_candidate_reason"
)


@query(
    "jn8_detect_repeat_contacts",
    with_sql(
        f"{EVENT_TICKETS_SQL},{REPEAT_SQL.format(source='event_tickets', days=7)}",
        f"SELECT {out(_REPEAT)} FROM repeat_contacts",
    ),
)
def _repeat(spark, sf):
    return link.repeat_contact_flags(event_tickets(spark, sf), 7)


# --- economics ----------------------------------------------------------------------------------------------------
# order tickets carry no channel or score defects, so their metrics need only the rules below
ORDER_METRICS_SQL = (
    ORDER_TICKETS_SQL
    + f""",
order_metrics AS (
  SELECT *, status IN ('resolved', 'closed') AS attendance_flag, csat_score IS NOT NULL AS csat_response_flag,
    csat_score IS NOT NULL AND status IN ('resolved', 'closed') AS valid_for_csat,
    CAST(csat_score AS INTEGER) AS csat_score_numeric, true AS valid_for_sla, true AS valid_for_first_response,
    (epoch_us(first_response_at) - epoch_us(created_at)) / 6e7 AS first_response_minutes,
    (epoch_us(first_response_at) - epoch_us(created_at)) / 6e7
      > CASE channel WHEN 'chat' THEN 15 WHEN 'voice' THEN 120 WHEN 'social' THEN 240 ELSE 480 END AS sla_breach_flag,
    CAST(transfers AS INTEGER) AS transfers_numeric,
    CASE WHEN status IN ('resolved', 'closed') AND resolved_at >= first_response_at
         THEN (epoch_us(resolved_at) - epoch_us(first_response_at)) / 6e7 END AS handle_time_minutes,
    strftime(created_at + INTERVAL 330 MINUTE, '%Y-%m') AS reporting_month,
    year(created_at + INTERVAL 330 MINUTE) || '-Q' || quarter(created_at + INTERVAL 330 MINUTE) AS reporting_quarter
  FROM order_tickets),{REPEAT_SQL.format(source='order_metrics', days=30)},
costed AS (
  SELECT r.*, replacement_issued = 'Y' AS replaced, p.family AS replacement_product_family, p.unit_cost_inr AS unit_cost,
    CASE channel WHEN 'chat' THEN 210 WHEN 'email' THEN 260 WHEN 'voice' THEN 520 ELSE 240 END::DECIMAL(18,2) AS contact,
    CASE WHEN sla_breach_flag THEN 350 ELSE 0 END::DECIMAL(18,2) AS sla,
    (coalesce(transfers_numeric, 0) * 305)::DECIMAL(18,2) AS transfer, coalesce(r.refund_amount_inr, 0)::DECIMAL(18,2) AS refund
  FROM repeat_contacts r LEFT JOIN products p ON replacement_issued = 'Y' AND product_sku = sku),
econ AS (
  SELECT * EXCLUDE (refund_amount_inr), coalesce(replaced, false) AS replacement_issued_flag,
    CASE WHEN replaced THEN (unit_cost + 340)::DECIMAL(18,2) WHEN coalesce(replaced, false) THEN NULL ELSE 0::DECIMAL(18,2) END
      AS replacement_cost_inr, contact AS contact_cost_inr, sla AS sla_breach_cost_inr, transfer AS transfer_cost_inr,
    refund AS refund_amount_inr, contact + sla + transfer AS operational_cost_exposure_inr,
    transfer AS internal_transfer_cost_exposure_inr, refund AS refund_exposure_inr,
    CASE WHEN replaced THEN (unit_cost + 340)::DECIMAL(18,2) ELSE 0::DECIMAL(18,2) END AS replacement_exposure_inr,
    contact + sla + transfer + coalesce(CASE WHEN replaced THEN unit_cost + 340 END, 0) + refund AS total_relevant_exposure_inr,
    coalesce(replaced AND unit_cost IS NULL, false) AS replacement_cost_missing_flag,
    coalesce(replaced AND refund > 0, false) AS refund_replacement_anomaly_flag,
    CASE WHEN replaced AND refund > 0 THEN refund + coalesce(unit_cost + 340, 0) ELSE 0 END
      AS refund_replacement_anomaly_exposure_inr,
    CASE WHEN repeat_contact_candidate_flag THEN contact ELSE 0 END AS repeat_contact_cost_inr,
    coalesce(transfers_numeric, 0) AS transfers_count
  FROM costed)"""
)


def order_metrics(spark, sf):
    return metrics.ticket_metrics(order_tickets(spark, sf))


def order_economics(spark, sf):
    """What other tables add is joined to the raw tickets, whose rows are about half as wide as those with metrics."""
    goods = product_dimension(spark, sf)
    tickets = link.detect_repeat_contacts(order_tickets(spark, sf), ServicePolicy().repeat_window_days)
    tickets = economics.with_replacement_product(tickets, goods)
    return economics.calculate_ticket_economics(metrics.ticket_metrics(tickets), goods)


def economics_table(spark, sf):
    return staged(spark, sf, "ticket_economics", order_economics)


@query(
    "eco1_policy_rates",
    with_sql(
        METRICS_SQL,
        """SELECT ticket_id, channel, CAST(CASE lower(channel) WHEN 'chat' THEN 210 WHEN 'email' THEN 260 WHEN 'voice' THEN 520
             WHEN 'social' THEN 240 END AS DOUBLE) AS contact_cost FROM ticket_metrics""",
    ),
)
def _rates(spark, sf):
    t = event_metrics(spark, sf)
    return t.select("ticket_id", "channel", economics.contact_cost(F.col("channel")).alias("contact_cost"))


_ECO_MONEY = (
    "contact_cost_inr sla_breach_cost_inr transfer_cost_inr replacement_cost_inr refund_amount_inr "
    "operational_cost_exposure_inr internal_transfer_cost_exposure_inr replacement_exposure_inr refund_exposure_inr "
    "total_relevant_exposure_inr refund_replacement_anomaly_exposure_inr"
)
_ECO_FLAGS = "replacement_issued_flag replacement_cost_missing_flag refund_replacement_anomaly_flag sla_breach_flag"


@query(
    "eco2_ticket_economics",
    with_sql(
        ORDER_METRICS_SQL,
        f"""SELECT {out('ticket_id replacement_product_family', 'transfers_count', money=_ECO_MONEY, flags=_ECO_FLAGS)} FROM econ""",
    ),
)
def _economics(spark, sf):
    rows = economics.ticket_economics(order_metrics(spark, sf), product_dimension(spark, sf), strict=True)
    return rows.select(
        "ticket_id", "replacement_product_family", "transfers_count", *_ECO_MONEY.split(), *_ECO_FLAGS.split()
    )


@query(
    "jn7_replacement_product_join",
    with_sql(
        ORDER_METRICS_SQL,
        f"""SELECT {out('ticket_id replacement_product_family', money='unit_cost')} FROM econ WHERE replacement_issued_flag""",
    ),
)
def _replacement_join(spark, sf):
    rows = economics.ticket_economics(order_metrics(spark, sf), product_dimension(spark, sf))
    return rows.filter("replacement_issued_flag").select(
        "ticket_id", "replacement_product_family", F.col("replacement_unit_cost_inr").alias("unit_cost")
    )


@query(
    "eco3_repeat_contact_cost",
    with_sql(
        ORDER_METRICS_SQL,
        f"""SELECT {out('ticket_id repeat_contact_candidate_flag repeat_contact_prior_ticket_id repeat_contact_candidate_reason',
              money='repeat_contact_cost_inr')} FROM econ""",
    ),
)
def _repeat_cost(spark, sf):
    return order_economics(spark, sf).select(
        "ticket_id", "repeat_contact_candidate_flag", "repeat_contact_prior_ticket_id", "repeat_contact_candidate_reason",
        "repeat_contact_cost_inr",
    )


_TOTALS_SQL = (
    ORDER_METRICS_SQL
    + f", totals AS (SELECT {', '.join(f'sum({f}) AS {f}' for f in economics.SUM_FIELDS)} FROM econ)"
)
_SCENARIOS_SQL = (
    _TOTALS_SQL
    + ", observed AS ("
    + " UNION ALL ".join(
        f"SELECT '{d}' AS cost_driver, {c} AS observed_exposure FROM totals" for d, c in economics.DRIVERS.items()
    )
    + """), scenarios AS (
  SELECT *, round(observed_exposure * scenario_reduction_rate::DECIMAL(6,4), 2) AS scenario_opportunity
  FROM observed, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) r(scenario_reduction_rate))"""
)


@query(
    "eco4_opportunity_scenarios",
    with_sql(
        _SCENARIOS_SQL,
        f"SELECT {out('cost_driver scenario_reduction_rate', money='observed_exposure scenario_opportunity')} FROM scenarios",
    ),
)
def _scenarios(spark, sf):
    return economics.opportunity_scenarios(economics.exposure_totals(economics_table(spark, sf)))


@query(
    "eco4_scenario_totals",
    with_sql(
        _SCENARIOS_SQL,
        f"""SELECT scenario_reduction_rate, CAST(sum(scenario_opportunity) AS DOUBLE) AS scenario_opportunity_total
            FROM scenarios WHERE cost_driver <> '{economics.REPEAT_SUBSET}' GROUP BY scenario_reduction_rate""",
    ),
)
def _scenario_totals(spark, sf):
    totals = economics.exposure_totals(economics_table(spark, sf))
    return economics.scenario_totals(economics.opportunity_scenarios(totals))


def _econ_select(keys: str) -> str:
    lead = ", ".join(keys.split()) + "," if keys else ""
    return f"""{lead} count(*) AS ticket_count, count_if(attendance_flag) AS completed_ticket_count,
      count_if(valid_for_sla) AS sla_eligible_count, count_if(sla_breach_flag) AS sla_breach_count,
      sum(transfers_count) AS transfer_count, count_if(replacement_issued_flag) AS replacement_count,
      count_if(replacement_cost_missing_flag) AS replacement_cost_missing_count,
      count_if(refund_amount_inr > 0) AS refund_ticket_count,
      count_if(refund_replacement_anomaly_flag) AS refund_replacement_anomaly_count,
      count_if(repeat_contact_candidate_flag) AS repeat_contact_candidate_count,
      count_if(sla_breach_flag) / nullif(count_if(valid_for_sla), 0) AS sla_breach_rate,
      sum(sla_breach_cost_inr)::DOUBLE / nullif(count_if(attendance_flag), 0) AS average_sla_breach_cost_per_completed_ticket_inr,
      sum(replacement_cost_inr)::DOUBLE / nullif(count_if(replacement_issued_flag AND replacement_cost_inr IS NOT NULL), 0)
        AS average_replacement_cost_inr,
      {', '.join(f'coalesce(sum({f}), 0) AS {f}' for f in economics.SUM_FIELDS)}"""


_ECON_N = (
    "ticket_count completed_ticket_count sla_eligible_count sla_breach_count transfer_count replacement_count "
    "replacement_cost_missing_count refund_ticket_count refund_replacement_anomaly_count repeat_contact_candidate_count"
)
_ECON_X = "sla_breach_rate average_sla_breach_cost_per_completed_ticket_inr average_replacement_cost_inr"
_ECON_MONEY = " ".join(economics.SUM_FIELDS)


def _rollup(name: str, keys: str, where: str = ""):
    sql = with_sql(
        ORDER_METRICS_SQL + f", g AS (SELECT {_econ_select(keys)} FROM econ {where and 'WHERE ' + where} "
        f"{'GROUP BY ' + ', '.join(keys.split()) if keys else ''})",
        f"SELECT {out(keys, _ECON_N, _ECON_X, _ECON_MONEY)} FROM g",
    )

    def run(spark, sf):
        rows = economics_table(spark, sf)
        rows = rows.filter(where) if where else rows
        columns = [*keys.split(), *_ECON_N.split(), *_ECON_X.split(), *_ECON_MONEY.split()]
        return economics.aggregate_economics(rows, keys.split()).select(*columns)

    query(name, sql)(run)


_rollup("agg18_aggregate_economics", "channel agent_tier")
_rollup("agg19_channel_economics", "channel")
_rollup("agg19_team_economics", "agent_team agent_tier")
_rollup("agg19_product_economics", "product_sku replacement_product_family", "replacement_issued_flag")
_rollup("agg19_refund_reason_economics", "refund_reason_code", "refund_amount_inr > 0")
_rollup("agg19_agent_economics", "agent_id", "attendance_flag AND agent_id IS NOT NULL")

_PERIOD_ECON_SQL = (
    ORDER_METRICS_SQL
    + f""",
sliced AS (SELECT *, 'full_available_period' AS period_type, 'all' AS period FROM econ
  UNION ALL SELECT *, 'month', reporting_month FROM econ UNION ALL SELECT *, 'quarter', reporting_quarter FROM econ),
g AS (SELECT {_econ_select('period_type period')} FROM sliced GROUP BY period_type, period),
periods AS (SELECT *, CASE WHEN period_type = 'quarter' THEN total_relevant_exposure_inr - prior END
      AS quarter_over_quarter_change_inr,
    CASE WHEN period_type = 'quarter' THEN round(total_relevant_exposure_inr::DOUBLE / nullif(prior, 0)::DOUBLE * 100 - 100, 2) END
      AS quarter_over_quarter_change_pct
  FROM (SELECT *, lag(total_relevant_exposure_inr) OVER (PARTITION BY period_type ORDER BY period) AS prior FROM g))"""
)


@query(
    "agg19_period_economics",
    with_sql(_PERIOD_ECON_SQL, f"SELECT {out('period_type period', _ECON_N, _ECON_X, _ECON_MONEY)} FROM periods"),
)
def _period_economics(spark, sf):
    rows = economics.period_economics(economics_table(spark, sf))
    return rows.select("period_type", "period", *_ECON_N.split(), *_ECON_X.split(), *_ECON_MONEY.split())


@query(
    "agg20_quarter_over_quarter",
    with_sql(
        _PERIOD_ECON_SQL,
        f"""SELECT {out('period', x='quarter_over_quarter_change_pct',
              money='total_relevant_exposure_inr quarter_over_quarter_change_inr')} FROM periods WHERE period_type = 'quarter'""",
    ),
)
def _quarter_change(spark, sf):
    rows = economics.period_economics(economics_table(spark, sf)).filter("period_type = 'quarter'")
    return rows.select(
        "period", "total_relevant_exposure_inr", "quarter_over_quarter_change_inr", "quarter_over_quarter_change_pct"
    )


@query("agg21_exposure_totals", with_sql(_TOTALS_SQL, f"SELECT {out(money=_ECON_MONEY)} FROM totals"))
def _totals(spark, sf):
    return economics.exposure_totals(economics_table(spark, sf))


_AVERAGED = ("1999-04", "1999-05", "1999-06")


@query(
    "agg21_claim_comparisons",
    with_sql(
        _PERIOD_ECON_SQL
        + f""",
f AS (SELECT max(ticket_count) FILTER (WHERE period = '1998-Q3') AS ticket_volume_before,
    max(ticket_count) FILTER (WHERE period = '1998-Q4') AS ticket_volume_after,
    max(replacement_count) FILTER (WHERE period = '1998-Q3') AS replacement_count_before,
    max(replacement_count) FILTER (WHERE period = '1998-Q4') AS replacement_count_after,
    max(replacement_exposure_inr) FILTER (WHERE period = '1998-12') AS replacement_exposure_month_before,
    max(replacement_exposure_inr) FILTER (WHERE period = '1999-06') AS replacement_exposure_month_after,
    sum(replacement_exposure_inr) FILTER (WHERE period IN {_AVERAGED}) / 3 AS monthly_average_replacement_exposure,
    max(period) FILTER (WHERE period_type = 'quarter') AS latest_observed_quarter,
    string_agg(period, '|' ORDER BY period) FILTER (WHERE period_type = 'quarter') AS available_quarters FROM periods)""",
        f"""SELECT {out('latest_observed_quarter available_quarters',
              'ticket_volume_before ticket_volume_after replacement_count_before replacement_count_after',
              money='replacement_exposure_month_before replacement_exposure_month_after monthly_average_replacement_exposure')},
            round(ticket_volume_after / ticket_volume_before * 100 - 100, 2) AS ticket_volume_change_pct,
            round(replacement_count_after / replacement_count_before * 100 - 100, 2) AS replacement_count_change_pct,
            round(replacement_exposure_month_after::DOUBLE / replacement_exposure_month_before::DOUBLE * 100 - 100, 2)
              AS replacement_exposure_change_pct FROM f""",
    ),
)
def _claims(spark, sf):
    periods = economics.period_economics(economics_table(spark, sf))
    return economics.claim_comparisons(periods, "1998-Q3", "1998-Q4", "1998-12", "1999-06", _AVERAGED)


@query(
    "val15_economics_invariants",
    with_sql(
        ORDER_METRICS_SQL,
        """SELECT unnest(['ticket_grain_reconciles', 'all_monetary_exposures_nonnegative',
                          'scenario_opportunity_within_driver_exposure']) AS name,
             unnest(['ticket_economics', 'ticket_economics', 'opportunity_scenarios']) AS dataset,
             unnest(['ticket_id', NULL, NULL]) AS field,
             unnest([CAST(count(*) - count(DISTINCT ticket_id) AS BIGINT), CAST(count_if(total_relevant_exposure_inr < 0) AS BIGINT),
                     CAST(0 AS BIGINT)]) AS count,
             unnest([CASE WHEN count(*) = count(DISTINCT ticket_id) THEN 'PASS' ELSE 'FAIL' END,
                     CASE WHEN count_if(total_relevant_exposure_inr < 0) = 0 THEN 'PASS' ELSE 'FAIL' END, 'PASS']) AS status
           FROM econ""",
    ),
)
def _invariants(spark, sf):
    rows = economics_table(spark, sf)
    scenarios = economics.opportunity_scenarios(economics.exposure_totals(rows))
    return validate.economics_invariants(rows, scenarios, economics.SUM_FIELDS)


# --- products -----------------------------------------------------------------------------------------------------
SUPPORT = 5
ENRICHED_SQL = (
    CHECKED_SQL
    + """,
exposed AS (
  SELECT l.*, p.product_name, p.family AS product_family, p.warranty_months, status IN ('resolved', 'closed') AS completed,
    coalesce(replacement_issued IN ('Y', 'N'), false) AS replacement_eligible, coalesce(replacement_issued = 'Y', false) AS replacement,
    coalesce(CASE WHEN replacement_issued = 'Y' THEN (p.unit_cost_inr + 340)::DECIMAL(18,2) END, 0) AS replacement_exposure_inr,
    csat_score IS NOT NULL AND status IN ('resolved', 'closed') AS csat_valid,
    CASE WHEN status IN ('resolved', 'closed') THEN CAST(csat_score AS INTEGER) END AS csat_score_value
  FROM linked_orders l LEFT JOIN products p ON l.product_sku = p.sku)"""
)


def enriched(spark, sf):
    rows = products.with_exposure(order_metrics(spark, sf), economics_table(spark, sf))
    return products.enrich_tickets(rows, order_dimension(spark, sf), product_dimension(spark, sf))


def enriched_table(spark, sf):
    return staged(spark, sf, "ticket_order_enriched", enriched)


@query(
    "eco5_enrichment_flags",
    with_sql(
        ENRICHED_SQL,
        f"""SELECT {out('ticket_id product_family', 'warranty_months csat_score_value', money='replacement_exposure_inr',
              flags='completed replacement_eligible replacement csat_valid')} FROM exposed""",
    ),
)
def _enriched(spark, sf):
    return enriched(spark, sf).select(
        "ticket_id", "product_family", "warranty_months", F.col("csat_score").alias("csat_score_value"),
        "replacement_exposure_inr", "completed", "replacement_eligible", "replacement", "csat_valid",
    )


def _product_sql(keys: str, where: str, having: str = "") -> str:
    return f"""SELECT {keys}, count(*) AS ticket_count, count_if(completed) AS completed_ticket_count,
      count_if(replacement_eligible) AS replacement_eligible_count, count_if(replacement) AS replacement_count,
      count_if(replacement) / nullif(count_if(replacement_eligible), 0) AS replacement_rate,
      sum(replacement_exposure_inr) AS replacement_exposure_inr, count(csat_score_value) AS csat_response_count,
      avg(csat_score_value) AS mean_csat,
      CASE WHEN count_if(replacement_eligible) >= {SUPPORT} THEN 'supported' ELSE 'below_minimum_support' END AS support_status
      FROM exposed WHERE {where} GROUP BY {keys} {having}"""


_LEVELS = {
    "product_sku": ("product_sku, product_name, product_family", "product_sku IS NOT NULL", ""),
    "product_family": ("product_family", "product_family IS NOT NULL", ""),
    "order_channel": ("order_channel", "order_match_status = 'matched' AND order_channel IS NOT NULL", ""),
    "lot": (
        "product_sku, product_name, product_family, order_lot_code",
        "order_match_status = 'matched' AND order_lot_code IS NOT NULL",
        f"HAVING count_if(replacement_eligible) >= {SUPPORT}",
    ),
    "agent_product": (
        "agent_id, product_sku, product_name, product_family",
        "agent_id IS NOT NULL AND product_sku IS NOT NULL",
        "",
    ),
}
_PROD_N = "ticket_count completed_ticket_count replacement_eligible_count replacement_count csat_response_count"
_PROD_X = "replacement_rate mean_csat"


def _level(name: str, level: str):
    keys, where, having = _LEVELS[level]
    shown = f"{keys.replace(',', '')} support_status"
    sql = with_sql(
        f"{ENRICHED_SQL}, g AS ({_product_sql(keys, where, having)})",
        f"SELECT {out(shown, _PROD_N, _PROD_X, 'replacement_exposure_inr')} FROM g",
    )

    def run(spark, sf):
        rows = products.product_levels(enriched_table(spark, sf), SUPPORT)[level]
        return rows.select(*shown.split(), *_PROD_N.split(), *_PROD_X.split(), "replacement_exposure_inr")

    query(name, sql)(run)


_level("agg22_product_aggregate", "product_sku")
_level("agg23_product_family", "product_family")
_level("agg23_order_channel", "order_channel")
_level("agg23_lot", "lot")
_level("agg23_agent_product", "agent_product")


@query(
    "agg24_agent_product_shares",
    with_sql(
        ENRICHED_SQL,
        """SELECT agent_id, product_sku, count(*) AS ticket_count,
             any_value(pn) AS product_ticket_count, any_value(an) AS agent_ticket_count,
             round(count(*) / any_value(pn), 6) AS share_of_product_tickets, round(count(*) / any_value(an), 6) AS share_of_agent_tickets
           FROM (SELECT *, count(*) OVER (PARTITION BY product_sku) AS pn, count(*) OVER (PARTITION BY agent_id) AS an FROM exposed)
           WHERE agent_id IS NOT NULL AND product_sku IS NOT NULL GROUP BY agent_id, product_sku""",
    ),
)
def _shares(spark, sf):
    return products.agent_product_shares(enriched_table(spark, sf), SUPPORT).select(
        "agent_id", "product_sku", "ticket_count", "product_ticket_count", "agent_ticket_count",
        "share_of_product_tickets", "share_of_agent_tickets",
    )


@query(
    "agg25_one_versus_rest",
    with_sql(
        f"""{ENRICHED_SQL},
s AS (SELECT product_sku, count(*) AS n, count_if(replacement_eligible) AS e, count_if(replacement) AS r,
  sum(replacement_exposure_inr) AS x, count(csat_score_value) AS c, sum(csat_score_value) AS v FROM exposed GROUP BY product_sku),
w AS (SELECT a.product_sku, any_value(a.n) AS ticket_count, any_value(a.r) / nullif(any_value(a.e), 0) AS replacement_rate,
    any_value(a.v) / nullif(any_value(a.c), 0) AS mean_csat, sum(b.n) AS other_ticket_count,
    sum(b.e) AS other_replacement_eligible_count, sum(b.r) AS other_replacement_count,
    sum(b.r) / nullif(sum(b.e), 0) AS other_replacement_rate, sum(b.x) AS other_replacement_exposure_inr,
    sum(b.c) AS other_csat_response_count, sum(b.v) / nullif(sum(b.c), 0) AS other_mean_csat
  FROM s a JOIN s b ON a.product_sku IS DISTINCT FROM b.product_sku WHERE a.product_sku IS NOT NULL GROUP BY a.product_sku)""",
        f"""SELECT {out('product_sku', 'ticket_count other_ticket_count other_replacement_eligible_count other_replacement_count '
              'other_csat_response_count', 'replacement_rate mean_csat other_replacement_rate other_mean_csat',
              'other_replacement_exposure_inr')} FROM w""",
    ),
)
def _one_rest(spark, sf):
    return products.one_versus_rest(enriched_table(spark, sf))


@query(
    "agg25_product_agent_exposure",
    with_sql(
        f"{ENRICHED_SQL}, g AS ({_product_sql(*_LEVELS['agent_product'])}), "
        "pn AS (SELECT product_sku, count(*) AS n FROM exposed GROUP BY product_sku)",
        f"""SELECT product_sku, count(*) AS supported_agent_count, min(ticket_count) AS ticket_count_min,
              max(ticket_count) AS ticket_count_max, round(min(replacement_rate), 6) AS replacement_rate_min,
              round(max(replacement_rate), 6) AS replacement_rate_max,
              round(max(ticket_count / n), 6) AS max_share_of_product_tickets
            FROM g JOIN pn USING (product_sku) WHERE replacement_eligible_count >= 2 GROUP BY product_sku""",
    ),
)
def _agent_exposure(spark, sf):
    return products.product_agent_exposure(products.agent_product_shares(enriched_table(spark, sf), SUPPORT), 2)


@query(
    "agg26_match_coverage",
    with_sql(
        ENRICHED_SQL,
        """SELECT count(*) AS ticket_count, count_if(order_match_status = 'matched') AS matched_count,
             count_if(order_match_status = 'ambiguous') AS ambiguous_count, count_if(order_match_status = 'unmatched') AS unmatched_count,
             round(count_if(order_match_status = 'matched') / count(*), 6) AS order_match_rate, count_if(replacement) AS replacement_count,
             round(count_if(replacement AND order_match_status = 'matched') / count_if(replacement), 6)
               AS replacement_order_match_coverage FROM exposed""",
    ),
)
def _coverage(spark, sf):
    return products.match_coverage(enriched_table(spark, sf))


@query(
    "dec16_top_products",
    with_sql(
        f"{ENRICHED_SQL}, g AS ({_product_sql(*_LEVELS['product_sku'])}), "
        f"""lists AS (
  (SELECT 'top_replacement_rate' AS list_name, * FROM g WHERE replacement_eligible_count >= {SUPPORT}
   ORDER BY coalesce(replacement_rate, 0) DESC, product_sku LIMIT 5)
  UNION ALL (SELECT 'top_replacement_exposure', * FROM g ORDER BY replacement_exposure_inr DESC, product_sku LIMIT 5)
  UNION ALL (SELECT 'lowest_csat', * FROM g WHERE csat_response_count >= {SUPPORT} ORDER BY mean_csat, product_sku LIMIT 5))""",
        f"SELECT {out('list_name product_sku support_status', _PROD_N, _PROD_X, 'replacement_exposure_inr')} FROM lists",
    ),
)
def _top(spark, sf):
    return products.top_products(products.product_levels(enriched_table(spark, sf), SUPPORT)["product_sku"], SUPPORT)


# --- overlays -----------------------------------------------------------------------------------------------------
@query(
    "jn12_keep_known_references",
    with_sql(
        EVENT_TICKETS_SQL,
        """, cited AS (SELECT agent_id, ticket_id FROM event_tickets
             QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY transfers DESC, ticket_id) <= 5),
           known AS (SELECT ticket_id FROM event_tickets WHERE category <> 'error' AND customer_message <> '')
           SELECT agent_id, coalesce(string_agg(ticket_id, '|' ORDER BY ticket_id)
               FILTER (WHERE ticket_id IN (SELECT * FROM known)), '') AS representative_ticket_ids,
             count(*) FILTER (WHERE ticket_id NOT IN (SELECT * FROM known)) AS removed_reference_count
           FROM cited GROUP BY agent_id""",
    ),
)
def _references(spark, sf):
    t = event_tickets(spark, sf)
    place = F.row_number().over(Window.partitionBy("agent_id").orderBy(F.col("transfers").desc(), "ticket_id"))
    cited = t.withColumn("place", place).filter("place <= 5")
    rows = cited.groupBy("agent_id").agg(F.array_sort(F.collect_list("ticket_id")).alias("representative_ticket_ids"))
    analysed, canonical = t.filter("category <> 'error'"), t.filter("customer_message <> ''")
    return link.keep_known_references(rows, "representative_ticket_ids", analysed, canonical, "agent_id")


@query(
    "jn13_unambiguous_name",
    """SELECT 'K' || n_nationkey AS agent_id, CASE WHEN count(DISTINCT s_name) = 1 THEN min(s_name) END AS agent_name
       FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""",
)
def _names(spark, sf):
    key = lambda c: F.concat(F.lit("K"), F.col(c).cast("string")).alias("agent_id")
    roster = table(spark, sf, "supplier").select(key("s_nationkey"), F.col("s_name").alias("name"))
    return link.unambiguous_name(table(spark, sf, "nation").select(key("n_nationkey")), roster)


@query(
    "agg9_assignment_metrics",
    with_sql(
        ORDER_METRICS_SQL
        + f""",{ROSTER_SQL},
a AS (SELECT o.*, r.site AS agent_site, r.shift AS agent_shift, r.from_date AS agent_from_date,
    CASE WHEN r.agent_id IS NOT NULL THEN 'matched' WHEN resolved_at IS NULL THEN 'missing_agent_or_time'
         ELSE 'no_roster_interval' END AS agent_assignment_flag
  FROM order_metrics o LEFT JOIN roster r ON o.agent_id = r.agent_id AND CAST(resolved_at AS DATE) >= r.from_date
    AND (r.to_date IS NULL OR CAST(resolved_at AS DATE) <= r.to_date)),
s AS (SELECT *, 'full_available_period' AS period_type, 'all' AS period FROM a
  UNION ALL SELECT *, 'month', reporting_month FROM a)""",
        """SELECT agent_id, agent_assignment_flag, agent_site, agent_shift, strftime(agent_from_date, '%Y-%m-%d') AS agent_from_date,
             period_type, period, count(*) AS ticket_count, count_if(valid_for_csat) AS csat_response_count,
             round(avg(csat_score_numeric) FILTER (WHERE valid_for_csat), 6) AS mean_csat,
             round(quantile_cont(handle_time_minutes, 0.5), 6) AS handle_time_median,
             round(avg(CASE WHEN sla_breach_flag THEN 1 ELSE 0 END), 6) AS sla_breach_rate
           FROM s GROUP BY agent_id, agent_assignment_flag, agent_site, agent_shift, agent_from_date, period_type, period""",
    ),
)
def _assignment_metrics(spark, sf):
    tickets = order_tickets(spark, sf).drop("agent_team", "agent_tier")
    rows = metrics.ticket_metrics(link.assign_roster(tickets, supplier_roster(spark, sf)))
    return metrics.assignment_metrics(rows).select(
        "agent_id", "agent_assignment_flag", "agent_site", "agent_shift", "agent_from_date", "period_type", "period",
        "ticket_count", "csat_response_count", "mean_csat", "handle_time_median", "sla_breach_rate",
    )
