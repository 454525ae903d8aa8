"""Peer groups, case-mix adjustment, stability and case mix (over work items derived from line items)."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskgauge.functions import intervals
from deskgauge.operators import link, metrics, mix, peers, stability, validate
from deskgauge.params import ASSIGNMENT, OUTCOMES
from deskgauge.plans.adapters import ROSTER_SQL, WORK_ITEMS_SQL, supplier_roster, work_items
from deskgauge.plans.catalog import out, query, staged, with_sql

KEYS = " ".join(ASSIGNMENT)
_ASSIGN_SHOWN = (
    "agent_id, agent_team, agent_tier, agent_site, agent_shift, strftime(agent_from_date, '%Y-%m-%d') AS agent_from_date, "
    "strftime(agent_to_date, '%Y-%m-%d') AS agent_to_date"
)

PEER_GROUPS_SQL = """
n1 AS (SELECT tier, team, site, shift, count(DISTINCT agent_id) AS n FROM roster GROUP BY ALL),
n2 AS (SELECT tier, team, count(DISTINCT agent_id) AS n FROM roster GROUP BY ALL),
n3 AS (SELECT tier, count(DISTINCT agent_id) AS n FROM roster GROUP BY ALL),
peer_groups AS (
  SELECT r.agent_id, r.team AS agent_team, r.tier AS agent_tier, r.site AS agent_site, r.shift AS agent_shift,
    r.from_date AS agent_from_date, r.to_date AS agent_to_date,
    CASE WHEN n1.n >= 3 THEN 'tier=' || r.tier || '|team=' || r.team || '|site=' || r.site || '|shift=' || r.shift
         WHEN n2.n >= 3 THEN 'tier=' || r.tier || '|team=' || r.team WHEN n3.n >= 3 THEN 'tier=' || r.tier END
      AS comparison_group,
    CASE WHEN n1.n >= 3 THEN 'tier_team_site_shift' WHEN n2.n >= 3 THEN 'tier_team' WHEN n3.n >= 3 THEN 'tier_only'
         ELSE 'insufficient_peers' END AS peer_fallback_level,
    CASE WHEN n1.n >= 3 THEN n1.n WHEN n2.n >= 3 THEN n2.n WHEN n3.n >= 3 THEN n3.n ELSE 0 END AS peer_agent_count,
    n3.n >= 3 AS peer_supported
  FROM roster r JOIN n1 USING (tier, team, site, shift) JOIN n2 USING (tier, team) JOIN n3 USING (tier))"""

GROUPED_ITEMS_SQL = (
    f"{WORK_ITEMS_SQL},{PEER_GROUPS_SQL}"
    + """,
items AS (
  SELECT w.*, g.comparison_group, coalesce(g.peer_fallback_level, 'unmatched_context') AS peer_fallback_level,
    coalesce(g.peer_agent_count, 0) AS peer_agent_count, coalesce(g.peer_supported, false) AS peer_supported
  FROM work_items w LEFT JOIN peer_groups g ON w.agent_assignment_flag = 'matched' AND w.agent_id = g.agent_id
    AND w.agent_from_date = g.agent_from_date)"""
)

_OBS = " UNION ALL ".join(
    f"SELECT *, '{o.name}' AS outcome, CAST({o.value} AS DOUBLE) AS v FROM items WHERE {o.eligible}" for o in OUTCOMES
)
_SLICES = """
  SELECT *, 'full_available_period' AS period_type, 'all' AS period FROM {0}
  UNION ALL SELECT *, 'quarter', reporting_quarter FROM {0} UNION ALL SELECT *, 'month', reporting_month FROM {0}"""
_A = ", ".join(ASSIGNMENT)
_KEY = f"{_A}, comparison_group, peer_fallback_level, peer_agent_count, peer_supported, period_type, period"


def _clip(expr: str, o, which: str) -> str:
    if o.gap_bounds is None:
        return expr
    return f"greatest({o.gap_bounds[0]}, {expr})" if which == "low" else f"least({o.gap_bounds[1]}, {expr})"


ADJUSTED_SQL = (
    f"{GROUPED_ITEMS_SQL},\nobs AS ({_OBS}),\nsliced AS ({_SLICES.format('obs')}),"
    + f"""
all_slices AS ({_SLICES.format('items')}),
levels(lvl) AS (VALUES (1), (2), (3), (4), (5)),
keyed AS (
  SELECT *, CASE lvl WHEN 1 THEN concat_ws('|', channel, priority, reporting_quarter, coalesce(product_family, '(missing)'))
    WHEN 2 THEN concat_ws('|', channel, priority, reporting_quarter) WHEN 3 THEN concat_ws('|', channel, priority)
    WHEN 4 THEN channel ELSE '' END AS ckey FROM sliced, levels),
pools AS (
  SELECT period_type, period, outcome, lvl, ckey, agent_id, v, unnest([
    'tier=' || agent_tier || '|team=' || agent_team || '|site=' || agent_site || '|shift=' || agent_shift,
    'tier=' || agent_tier || '|team=' || agent_team, 'tier=' || agent_tier]) AS pool
  FROM keyed WHERE peer_supported),
agentcell AS (SELECT pool, period_type, period, outcome, lvl, ckey, agent_id, count(*) AS n, sum(v) AS s, sum(v * v) AS q
  FROM pools GROUP BY ALL),
focal AS (SELECT DISTINCT comparison_group AS pool, period_type, period, outcome, lvl, ckey, agent_id FROM keyed
  WHERE comparison_group IS NOT NULL),
peercell AS (
  SELECT f.*, sum(a.n) AS n, sum(a.s) / sum(a.n) AS mean,
    CASE WHEN sum(a.n) > 1 THEN (sum(a.q) - sum(a.s) * sum(a.s) / sum(a.n)) / (sum(a.n) - 1) ELSE 0 END AS var,
    count(*) AS agents
  FROM focal f JOIN agentcell a USING (pool, period_type, period, outcome, lvl, ckey) WHERE a.agent_id <> f.agent_id
  GROUP BY ALL),
mixcell AS (
  SELECT {_KEY}, outcome, channel, priority, reporting_quarter, coalesce(product_family, '(missing)') AS fam,
    count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM sliced GROUP BY ALL),
tried AS (
  SELECT m.*, p.lvl, p.n AS pn, p.mean AS pmean, p.var AS pvar
  FROM mixcell m, levels l, peercell p
  WHERE p.lvl = l.lvl AND p.pool = m.comparison_group AND p.agent_id = m.agent_id AND p.period_type = m.period_type
    AND p.period = m.period AND p.outcome = m.outcome AND p.n >= 5 AND p.agents >= 2 AND p.ckey = CASE l.lvl
      WHEN 1 THEN concat_ws('|', channel, priority, reporting_quarter, fam)
      WHEN 2 THEN concat_ws('|', channel, priority, reporting_quarter) WHEN 3 THEN concat_ws('|', channel, priority)
      WHEN 4 THEN channel ELSE '' END
  QUALIFY row_number() OVER (PARTITION BY {', '.join('m.' + k.strip() for k in _KEY.split(','))}, m.outcome, channel, priority,
    reporting_quarter, fam ORDER BY p.lvl) = 1),
matched AS (
  SELECT {_KEY}, outcome, sum(n) AS cov, sum(s) AS sm, sum(q) AS qm, sum(n * pmean) AS ex, sum(n * pvar / pn) AS ev,
    [coalesce(sum(n) FILTER (WHERE lvl = 1), 0), coalesce(sum(n) FILTER (WHERE lvl = 2), 0),
     coalesce(sum(n) FILTER (WHERE lvl = 3), 0), coalesce(sum(n) FILTER (WHERE lvl = 4), 0),
     coalesce(sum(n) FILTER (WHERE lvl = 5), 0)] AS per_level
  FROM tried GROUP BY ALL),
observed AS (SELECT {_KEY}, outcome, count(*) AS n, avg(v) AS raw,
    CASE WHEN count(*) >= 2 THEN stddev_samp(v) / sqrt(count(*)) END AS raw_se FROM sliced GROUP BY ALL),
whole AS (SELECT pool, period_type, period, outcome, agent_id, n, agents FROM peercell WHERE lvl = 5),
tickets AS (SELECT {_KEY}, count(*) AS ticket_count FROM all_slices GROUP BY ALL),
est AS (
  SELECT o.*, coalesce(m.cov, 0) AS cov, m.ex / m.cov AS expected, (m.sm - m.ex) / m.cov AS gap,
    CASE WHEN m.cov >= 2 THEN sqrt((m.qm - m.sm * m.sm / m.cov) / (m.cov - 1) / m.cov + m.ev / (m.cov * m.cov)) END AS gap_se,
    sqrt(m.ev) / m.cov AS peer_se,
    CASE WHEN m.cov IS NULL THEN 'no_supported_peer_cell' ELSE ['channel_priority_period_product', 'channel_priority_period',
      'channel_priority', 'channel', 'peer_group_only'][list_position(per_level, list_max(per_level))] END AS fallback,
    coalesce(w.n, 0) AS peer_n, coalesce(w.agents, 0) AS peer_agents
  FROM observed o
  LEFT JOIN matched m ON {' AND '.join(f'o.{k.strip()} IS NOT DISTINCT FROM m.{k.strip()}' for k in _KEY.split(','))}
    AND o.outcome = m.outcome
  LEFT JOIN whole w ON w.pool = o.comparison_group AND w.period_type = o.period_type AND w.period = o.period
    AND w.outcome = o.outcome AND w.agent_id = o.agent_id),
ranged AS (
  SELECT *, CASE outcome {' '.join(f"WHEN '{o.name}' THEN {_clip('gap - 1.96 * gap_se', o, 'low')}" for o in OUTCOMES)} END AS lo0,
    CASE outcome {' '.join(f"WHEN '{o.name}' THEN {_clip('gap + 1.96 * gap_se', o, 'high')}" for o in OUTCOMES)} END AS hi0
  FROM est),
adjusted_long AS (
  SELECT * EXCLUDE (lo0, hi0), CASE WHEN gap_se IS NOT NULL THEN lo0 END AS lo, CASE WHEN gap_se IS NOT NULL THEN hi0 END AS hi,
    CASE WHEN gap_se IS NULL THEN 'insufficient' WHEN lo0 > 0 THEN 'higher' WHEN hi0 < 0 THEN 'lower' ELSE 'overlaps_zero' END
      AS direction FROM ranged),
adjusted AS (
  SELECT t.*, """
    + ", ".join(
        f"""{o.name}.raw AS {o.raw}, {o.name}.expected AS {o.peer}, {o.name}.gap AS {o.gap}, coalesce({o.name}.n, 0) AS {o.name}_eligible_count,
    coalesce({o.name}.peer_n, 0) AS {o.name}_peer_sample_size,
    coalesce({o.name}.peer_agents, 0) AS {o.name}_distinct_peer_count, coalesce({o.name}.cov, 0) AS {o.name}_adjustment_coverage_count,
    {o.name}.cov / {o.name}.n AS {o.name}_adjustment_coverage_rate, {o.name}.raw_se AS {o.name}_standard_error,
    {o.name}.gap_se AS {o.name}_gap_standard_error, {o.name}.lo AS {o.name}_gap_ci_lower, {o.name}.hi AS {o.name}_gap_ci_upper,
    coalesce({o.name}.direction, 'insufficient') AS {o.name}_gap_interval_direction,
    {o.name}.peer_se AS {o.name}_peer_mean_standard_error,
    coalesce({o.name}.fallback, 'no_supported_peer_cell') AS {o.name}_fallback_level"""
        for o in OUTCOMES
    )
    + " FROM tickets t "
    + " ".join(
        f"LEFT JOIN adjusted_long {o.name} ON {o.name}.outcome = '{o.name}' AND "
        + " AND ".join(f"t.{k.strip()} IS NOT DISTINCT FROM {o.name}.{k.strip()}" for k in _KEY.split(","))
        for o in OUTCOMES
    )
    + ")"
)
# counts of peers where the focal agent has no eligible ticket in a slice are not defined by the cells above
_ADJ_N = "ticket_count peer_agent_count " + " ".join(
    f"{o.name}_eligible_count {o.name}_adjustment_coverage_count" for o in OUTCOMES
)
_ADJ_X = " ".join(
    f"{o.raw} {o.peer} {o.gap} {o.name}_adjustment_coverage_rate {o.name}_standard_error {o.name}_gap_standard_error "
    f"{o.name}_gap_ci_lower {o.name}_gap_ci_upper {o.name}_peer_mean_standard_error"
    for o in OUTCOMES
)
_ADJ_K = "period_type period comparison_group peer_fallback_level " + " ".join(
    f"{o.name}_gap_interval_direction {o.name}_fallback_level" for o in OUTCOMES
)


def peer_groups_table(spark, sf):
    """The peer groups as a written stage: small, and read with its known size."""
    return staged(spark, sf, "peer_groups", lambda spark, sf: peers.build_peer_groups(supplier_roster(spark, sf)))


def grouped_items(spark, sf):
    roster = supplier_roster(spark, sf)
    return link.attach_peer_groups(work_items(spark, sf), peers.build_peer_groups(roster))


def peer_cells(spark, sf):
    """The cells of all work items as a written stage, one list per assignment."""
    return staged(spark, sf, "peer_cells", lambda spark, sf: peers.cell_lists(grouped_items(spark, sf)))


def adjusted(spark, sf):
    groups = peer_groups_table(spark, sf)
    store = lambda lists: staged(spark, sf, "peer_cells", lambda *_: lists)
    return peers.adjusted_agent_metrics(grouped_items(spark, sf), peer_groups=groups, store=store)


def adjusted_table(spark, sf):
    """The adjusted metrics as a written stage, for the queries that start from them."""
    return staged(spark, sf, "adjusted_agent_metrics", adjusted)


def comparison(spark, sf):
    rows = adjusted_table(spark, sf)
    return peers.agent_comparison(rows, stability.assess_adjusted_stability(rows))


@query("pg1_build_peer_groups", with_sql(f"{ROSTER_SQL},{PEER_GROUPS_SQL}", f"""SELECT {_ASSIGN_SHOWN}, comparison_group,
    peer_fallback_level, peer_agent_count, peer_supported, CAST(3 AS BIGINT) AS minimum_peer_agents FROM peer_groups"""))
def _peer_groups(spark, sf):
    return peers.build_peer_groups(supplier_roster(spark, sf))


@query(
    "pg2_pool_membership",
    with_sql(
        GROUPED_ITEMS_SQL,
        """SELECT pool, count(*) AS ticket_count, count(DISTINCT agent_id) AS agent_count FROM (
             SELECT agent_id, unnest(['tier=' || agent_tier || '|team=' || agent_team || '|site=' || agent_site || '|shift='
               || agent_shift, 'tier=' || agent_tier || '|team=' || agent_team, 'tier=' || agent_tier]) AS pool
             FROM items WHERE peer_supported) GROUP BY pool""",
    ),
)
def _pools(spark, sf):
    member = grouped_items(spark, sf).select("agent_id", F.explode(peers.pool_membership()).alias("pool"))
    by_agent = member.groupBy("pool", "agent_id").agg(F.count(F.lit(1)).alias("n"))
    return by_agent.groupBy("pool").agg(F.sum("n").alias("ticket_count"), F.count(F.lit(1)).alias("agent_count"))


@query(
    "pg3_adjusted_agent_metrics",
    with_sql(ADJUSTED_SQL, f"SELECT {_ASSIGN_SHOWN}, {out(_ADJ_K, _ADJ_N, _ADJ_X)} FROM adjusted"),
)
def _adjusted(spark, sf):
    return adjusted(spark, sf).select(*ASSIGNMENT, *_ADJ_K.split(), *_ADJ_N.split(), *_ADJ_X.split())


_PG4_KEYS = "period_type period csat_fallback_level handle_time_fallback_level sla_fallback_level"
_PG4 = (
    "csat_eligible_count csat_peer_sample_size csat_distinct_peer_count csat_adjustment_coverage_count "
    "handle_time_eligible_count handle_time_peer_sample_size handle_time_distinct_peer_count handle_time_adjustment_coverage_count "
    "sla_eligible_count sla_peer_sample_size sla_distinct_peer_count sla_adjustment_coverage_count"
)


@query(
    "pg4_cell_fallback_evidence",
    with_sql(
        ADJUSTED_SQL,
        f"""SELECT {_ASSIGN_SHOWN}, {out(_PG4_KEYS, _PG4)} FROM adjusted
            WHERE csat_eligible_count > 0 AND handle_time_eligible_count > 0 AND sla_eligible_count > 0""",
    ),
)
def _fallback(spark, sf):
    rows = adjusted_table(spark, sf).filter("csat_eligible_count > 0 and handle_time_eligible_count > 0 and sla_eligible_count > 0")
    return rows.select(*ASSIGNMENT, *_PG4_KEYS.split(), *_PG4.split())


# peers count for every assignment and period, also where the agent itself has no eligible ticket for the outcome
_PG4_ALL_SQL = (
    ADJUSTED_SQL
    + f""",
slice_peers AS (
  SELECT {', '.join(f't.{k.strip()}' for k in _KEY.split(','))}, a.outcome, sum(a.n) AS n, count(*) AS agents
  FROM tickets t JOIN agentcell a ON a.lvl = 5 AND a.pool = t.comparison_group AND a.period_type = t.period_type
    AND a.period = t.period AND a.agent_id <> t.agent_id GROUP BY ALL),
evidence AS (
  SELECT t.* REPLACE ({', '.join(f"coalesce(p_{o.name}.n, 0) AS {o.name}_peer_sample_size, coalesce(p_{o.name}.agents, 0) AS {o.name}_distinct_peer_count" for o in OUTCOMES)})
  FROM adjusted t {' '.join(f"LEFT JOIN slice_peers p_{o.name} ON p_{o.name}.outcome = '{o.name}' AND " + " AND ".join(f"t.{k.strip()} IS NOT DISTINCT FROM p_{o.name}.{k.strip()}" for k in _KEY.split(',')) for o in OUTCOMES)})"""
)


@query("pg4_cell_fallback_evidence_all", with_sql(_PG4_ALL_SQL, f"SELECT {_ASSIGN_SHOWN}, {out(_PG4_KEYS, _PG4)} FROM evidence"))
def _fallback_all(spark, sf):
    """Every assignment and period, also those without eligible tickets for some outcome."""
    return adjusted_table(spark, sf).select(*ASSIGNMENT, *_PG4_KEYS.split(), *_PG4.split())


STABILITY_SQL = f"""
stab AS (
  SELECT {_A}, outcome, count(*) AS qualifying_quarter_count, max(gap) - min(gap) AS quarterly_range,
    CASE WHEN count(*) < 2 THEN 'insufficient_period_evidence' WHEN max(lo) <= min(hi) THEN 'no_clear_shift_detected'
         ELSE 'variable_across_quarters' END AS stability_flag
  FROM adjusted_long WHERE period_type = 'quarter' AND comparison_group IS NOT NULL AND cov >= 2 AND lo IS NOT NULL
  GROUP BY ALL)"""

COMPARISON_SQL = (
    ADJUSTED_SQL
    + ","
    + STABILITY_SQL
    + f""",
comparison AS (
  SELECT *, CASE WHEN list_contains(flags, 'variable_across_quarters') THEN 'variable_across_quarters'
      WHEN len(list_filter(flags, lambda f: f = 'no_clear_shift_detected')) = 3 THEN 'no_clear_shift_detected'
      ELSE 'insufficient_period_evidence' END AS stability_flag,
    CASE WHEN peer_supported AND (csat_adjustment_coverage_count > 0 OR handle_time_adjustment_coverage_count > 0
        OR sla_adjustment_coverage_count > 0) THEN 'comparable'
      WHEN peer_fallback_level = 'unmatched_context' THEN 'no_effective_assignment' ELSE 'insufficient_peer_support' END
      AS comparison_status
  FROM (SELECT a.*, {', '.join(f"coalesce(s_{o.name}.stability_flag, 'insufficient_period_evidence') AS {o.name}_stability_flag" for o in OUTCOMES)},
      [{', '.join(f"coalesce(s_{o.name}.stability_flag, 'insufficient_period_evidence')" for o in OUTCOMES)}] AS flags
    FROM adjusted a {' '.join(f"LEFT JOIN stab s_{o.name} ON s_{o.name}.outcome = '{o.name}' AND a.agent_id = s_{o.name}.agent_id AND a.agent_from_date = s_{o.name}.agent_from_date" for o in OUTCOMES)}
    WHERE period_type = 'full_available_period'))"""
)

_COMPARED = (
    "comparison_group peer_fallback_level comparison_status stability_flag csat_stability_flag handle_time_stability_flag "
    "sla_stability_flag"
)


@query(
    "pg5_run_peer_analysis",
    with_sql(
        COMPARISON_SQL,
        f"SELECT {_ASSIGN_SHOWN}, {out(_COMPARED, 'ticket_count', 'csat_gap handle_time_gap sla_gap')} FROM comparison",
    ),
)
def _comparison(spark, sf):
    return comparison(spark, sf).select(
        *ASSIGNMENT, *_COMPARED.split(), "ticket_count", "csat_gap", "handle_time_gap", "sla_gap"
    )


# --- interval statistics ------------------------------------------------------------------------------------------
_INTERVAL = "sample_size", "mean standard_error ci_lower ci_upper"


@query(
    "sta1_mean_interval",
    f"""WITH g AS (SELECT l_suppkey, count(*) AS sample_size, avg(x) AS mean,
          CASE WHEN count(*) >= 2 THEN stddev_samp(x) / sqrt(count(*)) END AS standard_error
        FROM (SELECT l_suppkey, 1 + CAST(floor(l_quantity) AS INTEGER) % 5 AS x FROM lineitem) GROUP BY l_suppkey),
      b AS (SELECT *, CASE WHEN standard_error IS NOT NULL THEN greatest(1, mean - 1.96 * standard_error) END AS ci_lower,
              CASE WHEN standard_error IS NOT NULL THEN least(5, mean + 1.96 * standard_error) END AS ci_upper FROM g)
      SELECT {out('', 'l_suppkey sample_size', _INTERVAL[1])} FROM b""",
)
def _mean_interval(spark, sf):
    from deskgauge.plans.adapters import table

    lines = table(spark, sf, "lineitem").select("l_suppkey", (F.lit(1) + F.col("l_quantity").cast("int") % 5).alias("x"))
    return stability.grouped_mean_interval(lines, ["l_suppkey"], "x", (1, 5))


@query(
    "sta2_difference_interval",
    f"""WITH g AS (SELECT l_suppkey, avg(x) FILTER (WHERE r) AS ma, avg(x) FILTER (WHERE NOT r) AS mb,
          stddev_samp(x) FILTER (WHERE r) / sqrt(count(*) FILTER (WHERE r)) AS sa,
          stddev_samp(x) FILTER (WHERE NOT r) / sqrt(count(*) FILTER (WHERE NOT r)) AS sb
        FROM (SELECT l_suppkey, 1 + CAST(floor(l_quantity) AS INTEGER) % 5 AS x, l_returnflag = 'R' AS r FROM lineitem)
        GROUP BY l_suppkey),
      d AS (SELECT l_suppkey, ma - mb AS gap, sqrt(sa * sa + sb * sb) AS standard_error FROM g),
      b AS (SELECT *, CASE WHEN standard_error IS NOT NULL THEN greatest(-4, gap - 1.96 * standard_error) END AS ci_lower,
              CASE WHEN standard_error IS NOT NULL THEN least(4, gap + 1.96 * standard_error) END AS ci_upper FROM d)
      SELECT {out('', 'l_suppkey', 'gap standard_error ci_lower ci_upper')} FROM b""",
)
def _difference(spark, sf):
    from deskgauge.plans.adapters import table

    x, returned = F.lit(1) + F.col("l_quantity").cast("int") % 5, F.col("l_returnflag") == "R"
    a = intervals.mean_interval(F.when(returned, x).cast("double"))
    b = intervals.mean_interval(F.when(~returned, x).cast("double"))
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        a["mean"].alias("ma"), a["standard_error"].alias("sa"), b["mean"].alias("mb"), b["standard_error"].alias("sb")
    )
    gap = intervals.difference_interval(F.col("ma"), F.col("sa"), F.col("mb"), F.col("sb"), (-4, 4))
    return g.select("l_suppkey", *[c.alias(n) for n, c in gap.items()])


_GAP = "handle_time_gap handle_time_gap_standard_error handle_time_gap_ci_lower handle_time_gap_ci_upper"


@query(
    "sta3_standardized_gap_interval",
    with_sql(ADJUSTED_SQL, f"SELECT {_ASSIGN_SHOWN}, {out('period', '', _GAP)} FROM adjusted WHERE period_type = 'quarter'"),
)
def _gap_interval(spark, sf):
    return adjusted_table(spark, sf).filter("period_type = 'quarter'").select(*ASSIGNMENT, "period", *_GAP.split())


@query(
    "sta4_evidence_label",
    with_sql(
        WORK_ITEMS_SQL,
        """SELECT agent_id, reporting_quarter, CASE WHEN count_if(valid_for_csat) < 30 THEN 'below 30 eligible rows'
             ELSE '30 eligible rows or more, see the interval' END AS evidence
           FROM work_items GROUP BY agent_id, reporting_quarter""",
    ),
)
def _evidence(spark, sf):
    n = F.count_if("valid_for_csat")
    grouped = work_items(spark, sf).groupBy("agent_id", "reporting_quarter").agg(n.alias("n"))
    return grouped.select("agent_id", "reporting_quarter", intervals.evidence_label(F.col("n")).alias("evidence"))


PERIOD_OUTCOMES_SQL = (
    GROUPED_ITEMS_SQL
    + f""",
obs AS ({' UNION ALL '.join(f"SELECT *, '{o.name}' AS outcome, CASE WHEN {o.eligible} THEN CAST({o.value} AS DOUBLE) END AS v FROM items" for o in OUTCOMES)}),
sliced AS (SELECT *, 'quarter' AS period_type, reporting_quarter AS period FROM obs
  UNION ALL SELECT *, 'month', reporting_month FROM obs),
po AS (SELECT {_A}, period_type, period, outcome, count(v) AS eligible_count, avg(v) AS mean,
    CASE WHEN count(v) >= 2 THEN stddev_samp(v) / sqrt(count(v)) END AS standard_error FROM sliced GROUP BY ALL),
period_outcomes AS (
  SELECT *, CASE WHEN standard_error IS NOT NULL THEN CASE outcome WHEN 'csat' THEN greatest(1, mean - 1.96 * standard_error)
      WHEN 'sla' THEN greatest(0, mean - 1.96 * standard_error) ELSE mean - 1.96 * standard_error END END AS ci_lower,
    CASE WHEN standard_error IS NOT NULL THEN CASE outcome WHEN 'csat' THEN least(5, mean + 1.96 * standard_error)
      WHEN 'sla' THEN least(1, mean + 1.96 * standard_error) ELSE mean + 1.96 * standard_error END END AS ci_upper
  FROM po)"""
)


@query(
    "sta5_period_outcomes",
    with_sql(
        PERIOD_OUTCOMES_SQL,
        f"""SELECT {_ASSIGN_SHOWN}, {out('period_type period outcome', 'eligible_count', 'mean standard_error ci_lower ci_upper')}
            FROM period_outcomes""",
    ),
)
def _period_outcomes(spark, sf):
    return stability.period_outcomes(work_items(spark, sf))


# every pair of quarters is compared here, where the operator uses one aggregation
@query(
    "sta6_assess_stability",
    with_sql(
        PERIOD_OUTCOMES_SQL,
        f"""SELECT {_ASSIGN_SHOWN}, outcome, count(*) AS qualifying_quarter_count,
              round(max(mean) - min(mean), 6) + 0.0 AS quarterly_range,
              CASE WHEN count(*) < 2 THEN 'insufficient_period_evidence'
                WHEN bool_and(clear) THEN 'no_clear_shift_detected' ELSE 'variable_across_quarters' END AS stability_flag
            FROM (SELECT a.*, (SELECT coalesce(bool_and(greatest(a.ci_lower, b.ci_lower) <= least(a.ci_upper, b.ci_upper)), true)
                    FROM period_outcomes b WHERE b.agent_id = a.agent_id AND b.outcome = a.outcome
                      AND b.agent_from_date IS NOT DISTINCT FROM a.agent_from_date AND b.period_type = 'quarter'
                      AND b.eligible_count >= 2 AND b.ci_lower IS NOT NULL) AS clear
                  FROM period_outcomes a WHERE a.period_type = 'quarter' AND a.eligible_count >= 2 AND a.ci_lower IS NOT NULL)
            GROUP BY ALL""",
    ),
)
def _stability(spark, sf):
    return stability.assess_stability(stability.period_outcomes(work_items(spark, sf)))


@query(
    "sta7_assess_adjusted_stability",
    with_sql(
        f"{ADJUSTED_SQL},{STABILITY_SQL}",
        f"SELECT {_ASSIGN_SHOWN}, {out('outcome stability_flag', 'qualifying_quarter_count', 'quarterly_range')} FROM stab",
    ),
)
def _adjusted_stability(spark, sf):
    return stability.assess_adjusted_stability(adjusted_table(spark, sf))


# --- summaries by assignment and case mix -------------------------------------------------------------------------
_MIX_DIMS = " UNION ALL ".join(
    f"SELECT {_A}, period_type, period, '{d}' AS dimension, coalesce(nullif(CAST({d} AS VARCHAR), ''), '(missing)') AS level FROM sliced"
    for d in mix.DIMENSIONS
)
CASE_MIX_SQL = (
    WORK_ITEMS_SQL
    + f""",
sliced AS (SELECT *, 'full_available_period' AS period_type, 'all' AS period FROM work_items
  UNION ALL SELECT *, 'quarter', reporting_quarter FROM work_items),
dims AS ({_MIX_DIMS}),
mix AS (SELECT *, sum(ticket_count) OVER (PARTITION BY {_A}, period_type, period, dimension) AS dimension_denominator
  FROM (SELECT {_A}, period_type, period, dimension, level, count(*) AS ticket_count FROM dims GROUP BY ALL)),
case_mix AS (SELECT *, ticket_count / dimension_denominator AS share, level = '(missing)' AS missing_level_flag FROM mix)"""
)


@query(
    "agg12_case_mix_metrics",
    with_sql(
        CASE_MIX_SQL,
        f"""SELECT {_ASSIGN_SHOWN}, {out('period_type period dimension level', 'ticket_count dimension_denominator', 'share',
              flags='missing_level_flag')} FROM case_mix""",
    ),
)
def _case_mix(spark, sf):
    return mix.case_mix_metrics(work_items(spark, sf))


@query(
    "agg13_case_mix_ranges",
    with_sql(
        CASE_MIX_SQL,
        """SELECT dimension, level, round(min(share), 6) AS minimum_agent_share, round(max(share), 6) AS maximum_agent_share
           FROM case_mix WHERE period_type = 'full_available_period' AND agent_tier IS NOT NULL AND dimension_denominator >= 30
             AND dimension IN ('channel', 'priority', 'category', 'product_family') GROUP BY dimension, level""",
    ),
)
def _mix_ranges(spark, sf):
    return mix.case_mix_ranges(mix.case_mix_metrics(work_items(spark, sf)))


@query(
    "agg14_case_mix_summary",
    with_sql(
        CASE_MIX_SQL
        + """,
probe AS (SELECT * FROM case_mix WHERE period_type = 'full_available_period')""",
        f"""SELECT {_ASSIGN_SHOWN}, count(DISTINCT dimension) AS dimensions, count(*) AS levels,
              round(sum(round(share, 6)) FILTER (WHERE dimension = 'channel' AND level = 'A'), 6) + 0.0 AS channel_a_share
            FROM probe GROUP BY ALL""",
    ),
)
def _mix_summary(spark, sf):
    packed = mix.case_mix_summary(mix.case_mix_metrics(work_items(spark, sf)))
    parsed = F.from_json("case_mix_summary", "map<string,map<string,double>>")
    rows = packed.withColumn("m", parsed)
    return rows.select(
        *ASSIGNMENT,
        F.size("m").alias("dimensions"),
        F.aggregate(F.map_values("m"), F.lit(0), lambda n, x: n + F.size(x)).alias("levels"),
        F.try_element_at(F.try_element_at("m", F.lit("channel")), F.lit("A")).alias("channel_a_share"),
    )


@query(
    "agg16_gap_summary",
    with_sql(
        COMPARISON_SQL,
        " UNION ALL ".join(
            f"""SELECT '{o.name}' AS outcome, count({o.gap}) AS adjusted_comparison_count,
              count_if({o.gap} > 0) AS positive_gap_count, count_if({o.gap} < 0) AS negative_gap_count,
              count_if({o.gap} = 0) AS zero_gap_count,
              {', '.join(f"count_if({o.gap} IS NOT NULL AND {o.name}_gap_interval_direction = '{d}') AS direction_{d}_count" for d in ('higher', 'lower', 'overlaps_zero', 'insufficient'))},
              count_if(c AND {o.name}_adjustment_coverage_count > 0) AS assignments_with_any_coverage,
              count_if(c AND {o.name}_adjustment_coverage_count = 0) AS zero_coverage_assignment_count,
              round(avg({o.name}_adjustment_coverage_rate) FILTER (WHERE c), 6) AS mean_coverage_rate,
              round(min({o.name}_adjustment_coverage_rate) FILTER (WHERE c), 6) AS minimum_coverage_rate,
              count_if(c AND {o.name}_eligible_count < 30) AS low_evidence_assignment_count,
              round(quantile_cont(abs({o.gap}), 0.5), 6) AS median_absolute_gap
            FROM (SELECT *, comparison_status = 'comparable' AS c FROM comparison)"""
            for o in OUTCOMES
        ),
    ),
)
def _gap_summary(spark, sf):
    return peers.gap_summary(comparison(spark, sf))


@query(
    "agg16_fallback_histogram",
    with_sql(
        COMPARISON_SQL,
        " UNION ALL ".join(
            f"""SELECT '{o.name}' AS outcome, {o.name}_fallback_level AS level, count(*) AS assignment_count FROM comparison
                WHERE comparison_status = 'comparable' GROUP BY ALL"""
            for o in OUTCOMES
        ),
    ),
)
def _fallbacks(spark, sf):
    return peers.fallback_histogram(comparison(spark, sf))


@query(
    "agg16_low_evidence_agents",
    with_sql(
        ADJUSTED_SQL,
        " UNION ALL ".join(
            f"""SELECT DISTINCT CASE WHEN period_type = 'full_available_period' THEN 'full_period' ELSE 'any_month_or_quarter' END
                  AS scope, '{o.name}' AS outcome, agent_id FROM adjusted
                WHERE comparison_group IS NOT NULL AND {o.name}_eligible_count < 30 AND (period_type <> 'full_available_period'
                  OR csat_adjustment_coverage_count > 0 OR handle_time_adjustment_coverage_count > 0
                  OR sla_adjustment_coverage_count > 0)"""
            for o in OUTCOMES
        ),
    ),
)
def _low_evidence(spark, sf):
    return peers.low_evidence_agents(adjusted_table(spark, sf))


@query(
    "agg17_peer_group_summary",
    with_sql(
        f"{ROSTER_SQL},{PEER_GROUPS_SQL}",
        """SELECT comparison_group, count(*) AS selected_assignment_count, max(peer_agent_count) AS agent_count,
             min(peer_fallback_level) AS fallback_level, string_agg(DISTINCT agent_tier, '|' ORDER BY agent_tier) AS tiers,
             string_agg(DISTINCT agent_team, '|' ORDER BY agent_team) AS teams
           FROM peer_groups WHERE comparison_group IS NOT NULL GROUP BY comparison_group""",
    ),
)
def _group_summary(spark, sf):
    return peers.peer_group_summary(peers.build_peer_groups(supplier_roster(spark, sf)))


@query(
    "val13_cohort_purity",
    with_sql(
        f"{ROSTER_SQL},{PEER_GROUPS_SQL}",
        """SELECT comparison_group, count(DISTINCT agent_tier) AS tier_count,
             CASE WHEN count(DISTINCT agent_tier) = 1 THEN 'PASS' ELSE 'FAIL' END AS status
           FROM peer_groups WHERE comparison_group IS NOT NULL GROUP BY comparison_group""",
    ),
)
def _purity(spark, sf):
    return validate.cohort_purity(peers.build_peer_groups(supplier_roster(spark, sf)))
