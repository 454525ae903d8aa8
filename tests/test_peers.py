"""Leave-one-out adjustment against brute force, with pools cut into parts."""

from __future__ import annotations

import random
from datetime import date

import pytest

from deskgauge.operators import link, peers
from deskgauge.params import ASSIGNMENT, PeerSpec
from deskgauge.plans.catalog import configure

MIX = ("channel", "priority", "reporting_quarter", "reporting_month", "product_family")
LEVELS = {
    "full_available_period": ("cpqf", "cpq", "cp", "c", ""),
    "quarter": ("cpqf", "cpq", "cpq", "cq", "q"),
    "month": ("cpmf", "cpm", "cpm", "cm", "m"),
}
SCHEMA = (
    "agent_id string, agent_team string, agent_tier string, agent_site string, agent_shift string, agent_from_date date, "
    "agent_to_date date, comparison_group string, peer_fallback_level string, peer_agent_count bigint, peer_supported boolean, "
    "channel string, priority string, reporting_quarter string, reporting_month string, product_family string, "
    "valid_for_csat boolean, csat_score_numeric int, valid_for_handle_time boolean, handle_time_minutes double, "
    "valid_for_sla boolean, sla_breach_flag boolean"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _tickets() -> list[dict]:
    rng = random.Random(5)
    found = []
    for i in range(900):
        agent = rng.choice([None, *range(14)])
        team = "x" if agent is None else "abc"[agent % 3]
        fine, coarse = f"tier=T|team={team}|site=s|shift=d", "tier=T"
        # team c is compared with its whole tier, so its pool holds the tickets of all teams
        group = None if agent == 13 else coarse if team == "c" else fine
        month = rng.choice(["2024-01", "2024-02", "2024-04", None])
        quarter = month and f"2024-Q{(int(month[-2:]) + 2) // 3}"
        score, minutes = rng.choice([None, 1, 3, 5]), rng.choice([None, 4.0, 9.0])
        row = (
            None if agent is None else f"A{agent}", team, "T", "s", "d", date(2024, 1, 1 + i % 2), None, group, "some", 4, group is not None,
            rng.choice(["chat", "chat", "voice"]), rng.choice(["High", "", None]), quarter, month, rng.choice(["f", "g", None]),
            score is not None, score, minutes is not None, minutes, True, rng.random() < 0.3,
        )
        found.append(dict(zip(_NAMES, row, strict=True)))
    return found


def _cell(row: dict, parts: str) -> tuple:
    names = {"c": "channel", "p": "priority", "q": "reporting_quarter", "m": "reporting_month", "f": "product_family"}
    return tuple(row[names[x]] or "(missing)" for x in parts)


def _expected(rows: list[dict], value) -> dict:
    """(assignment, period type, period): tickets with a supported stratum and the mean expected of them."""

    def pools(row):
        labels = {f"tier=T|team={row['agent_team']}|site=s|shift=d", f"tier=T|team={row['agent_team']}", "tier=T"}
        return labels if row["comparison_group"] else set()

    found: dict = {}
    for row in rows:
        for kind, levels in LEVELS.items():
            period = {"quarter": row["reporting_quarter"], "month": row["reporting_month"]}.get(kind, "all")
            if period is None:
                continue
            key = (*[row[k] for k in (*ASSIGNMENT, "comparison_group")], kind, period)
            covered, total = found.get(key, (0, 0.0))
            if value(row) is not None:
                for parts in levels:
                    others = [
                        r for r in rows
                        if row["comparison_group"] in pools(r) and r["agent_id"] != row["agent_id"]
                        and value(r) is not None and _cell(r, parts) == _cell(row, parts)
                    ]
                    if len(others) >= 5 and len({r["agent_id"] for r in others}) >= 2:
                        covered, total = covered + 1, total + sum(map(value, others)) / len(others)
                        break
            found[key] = covered, total
    return {k: (n, round(t / n, 9) if n else None) for k, (n, t) in found.items()}


@pytest.mark.parametrize("agents, parts", [(512, 4096), (1, 7)])
def test_adjustment_is_leave_one_out_however_pools_are_cut(spark, monkeypatch, agents, parts):
    monkeypatch.setattr(peers, "PART_AGENTS", agents)
    monkeypatch.setattr(peers, "PARTS", parts)
    rows = _tickets()
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = peers.adjusted_agent_metrics(df, PeerSpec()).collect()
    for name, peer, value in (
        ("csat", "peer_mean_csat", lambda r: r["csat_score_numeric"]),
        ("handle_time", "peer_handle_time_mean", lambda r: r["handle_time_minutes"]),
        ("sla", "peer_sla_breach_rate", lambda r: float(r["sla_breach_flag"])),
    ):
        want = _expected(rows, value)
        have = {
            (*[r[k] for k in (*ASSIGNMENT, "comparison_group", "period_type", "period")],): (
                r[f"{name}_adjustment_coverage_count"],
                None if r[peer] is None else round(r[peer], 9),
            )
            for r in got
        }
        assert have == want


def test_peer_groups_do_not_move_tickets_again(spark, tmp_path):
    """Tickets dealt by agent for the roster stay there; a missing agent's assignment is found as well."""
    roster = [("A1", "t"), ("A1", "u"), ("A2", "t"), ("A3", "t"), (None, "t")]
    shape = "agent_id string, team string, tier string, site string, shift string, from_date date, to_date date"
    groups = peers.build_peer_groups(spark.createDataFrame([(a, t, "T", "s", "d", None, None) for a, t in roster], shape))
    named = ", ".join(f"{k} {'date' if k.endswith('date') else 'string'}" for k in ASSIGNMENT)
    rows = [(a, t, "T", "s", "d", None, None, flag) for a, t in [*roster, ("A9", "t")] for flag in ("matched", "no")]
    tickets = spark.createDataFrame(rows, f"{named}, agent_assignment_flag string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = link.attach_peer_groups(tickets.repartition("agent_id"), groups)
        got = {(r.agent_id, r.agent_team, r.agent_assignment_flag): r.comparison_group for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    fine, tier = "tier=T|team=t|site=s|shift=d", "tier=T"
    known = {(a, t): fine if t == "t" else tier for a, t in roster}
    assert got == {(a, t, f): known.get((a, t)) if f == "matched" else None for a, t, *_, f in rows}
    assert "coalesce(agent_from_date" not in plan


def test_cells_travel_as_one_list_per_assignment(spark):
    rows, kept = _tickets(), []
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    peers.adjusted_agent_metrics(df, PeerSpec(), store=lambda cells: kept.append(cells) or cells)
    assert kept[0].count() == len({(*[r[k] for k in ASSIGNMENT], r["comparison_group"]) for r in rows})
    assert sum(c.tickets for r in kept[0].collect() for c in r.cells) == len(rows)


def test_wide_projections_are_left_to_compiled_code(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    configure(spark)
    # HotSpot leaves methods above 8,000 bytes interpreted; below Spark's own limit it would still run them
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_totals_are_added_up_from_the_cells(spark):
    rows = _tickets()
    lists = peers.cell_lists(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA))
    got = {r.agent_id: (r.tickets, r.n_csat, r.sum_csat, r.n_handle_time, r.sum_handle_time, r.n_sla, r.sum_sla) for r in peers.cell_totals(lists, ["agent_id"]).collect()}
    want = {}
    for agent in {r["agent_id"] for r in rows}:
        own = [r for r in rows if r["agent_id"] == agent]
        scores, minutes = ([r[v] for r in own if r[v] is not None] for v in ("csat_score_numeric", "handle_time_minutes"))
        want[agent] = len(own), len(scores), sum(scores), len(minutes), sum(minutes), len(own), sum(r["sla_breach_flag"] for r in own)
    assert got == want


def test_agent_totals_do_not_read_the_facts_again(spark):
    from deskgauge.plans.decision_queries import agent_totals

    plan = agent_totals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan and "Join" not in plan


def test_a_ticket_meets_its_assignment_in_the_join(spark):
    """Of the assignments of its agent a ticket takes the one that equals its own, missing values included."""
    shape = "agent_id string, team string, tier string, site string, shift string, from_date date, to_date date"
    groups = peers.build_peer_groups(spark.createDataFrame([("A1", t, "T", None, "d", None, None) for t in ("t", None, "u")], shape))
    named = ", ".join(f"{k} {'date' if k.endswith('date') else 'string'}" for k in ASSIGNMENT)
    rows = [("A1", t, "T", None, "d", None, None, "matched") for t in ("t", None, "u", "w")]
    found = link.attach_peer_groups(spark.createDataFrame(rows, f"{named}, agent_assignment_flag string"), groups)
    assert {r.agent_team: r.peer_fallback_level for r in found.collect()} == dict.fromkeys(("t", None, "u"), "insufficient_peers") | {"w": "unmatched_context"}
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__groups" not in joined
