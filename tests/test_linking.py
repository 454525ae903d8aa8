"""Roster, order links, repeat contacts, peer groups, stability."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from deskgauge.operators import economics, link, peers, stability

ROSTER = "agent_id string, name string, site string, team string, shift string, tier string, from_date date, to_date date"


def roster(spark, *rows):
    return spark.createDataFrame([(a, a, "s", t, "day", tier, f, e) for a, t, tier, f, e in rows], ROSTER)


D = dt.date
T = dt.datetime


def test_roster_intervals_are_inclusive_and_overlaps_show(spark):
    table = roster(spark, ("A", "x", "T1", D(2025, 1, 1), D(2025, 1, 31)), ("A", "y", "T1", D(2025, 2, 1), None), ("A", "z", "T1", D(2025, 3, 1), D(2025, 3, 2)), ("B", "x", "T1", D(2025, 2, 1), D(2025, 1, 1)))
    days = [("1", "A", T(2025, 1, 31, 23)), ("2", "A", T(2025, 2, 1)), ("3", "A", T(2024, 12, 31)), ("4", "A", T(2025, 3, 2, 5)), ("5", "A", T(2025, 3, 3)), ("6", "A", None), ("7", "B", T(2025, 1, 15)), ("8", "Z", T(2025, 1, 15))]
    tickets = spark.createDataFrame(days, "ticket_id string, agent_id string, resolved_at timestamp")
    got = {r["ticket_id"]: (r["agent_team"], r["agent_assignment_flag"]) for r in link.assign_roster(tickets, table).collect()}
    assert got == {
        "1": ("x", "matched"), "2": ("y", "matched"), "3": (None, "no_roster_interval"), "4": (None, "overlapping_roster"),
        "5": ("y", "matched"), "6": (None, "missing_agent_or_time"), "7": (None, "no_roster_interval"), "8": (None, "no_roster_interval"),
    }


ORDERS = "order_id string, customer_id string, sku string, order_date date, channel string, qty int, order_value_inr decimal(18,2), lot_code string"


def test_checked_order_link(spark):
    orders = spark.createDataFrame([(o, c, s, None, "web", 1, None, "L") for o, c, s in (("O1", "C1", "S1"), ("O2", "C2", "S2"), ("O3", "C3", "S3"), ("O4", "C3", "S3"))], ORDERS)
    rows = [("1", "O1", "C1", "S1"), ("2", None, "C2", "S2"), ("3", None, "C3", "S3"), ("4", None, "C9", "S9"), ("5", "O9", "C9", "S9"), ("6", "O1", "C2", "S1"), ("7", "O9", "C2", "S2"), ("8", "O1", None, "S1"), ("9", "O1", None, None)]
    tickets = spark.createDataFrame(rows, "ticket_id string, order_id string, customer_id string, product_sku string")
    got = {r["ticket_id"]: (r["order_match_status"], r["order_match_method"], r["order_id"]) for r in link.link_orders_checked(tickets, orders).collect()}
    assert got == {
        "1": ("matched", "direct_order_id", "O1"), "2": ("matched", "unique_customer_sku", "O2"),
        "3": ("ambiguous", "multiple_customer_sku_orders", None), "4": ("unmatched", None, None), "5": ("unmatched", None, None),
        "6": ("ambiguous", "conflicting_direct_order_id", None), "7": ("matched", "unique_customer_sku", "O2"),
        "8": ("matched", "direct_order_id", "O1"), "9": ("ambiguous", "conflicting_direct_order_id", None),
    }
    basic = {r["ticket_id"]: r["order_match_flag"] for r in link.link_orders_basic(tickets, orders).collect()}
    assert basic["6"] == "matched" and basic["3"] == "missing_order_id" and basic["5"] == "unmatched_order"


def test_linked_orders_travel_without_what_was_compared(spark):
    """Customer and product of an order are met at the first join; of the order only what the link hands on goes to the second."""
    orders = spark.createDataFrame([("O1", "C1", "S1", D(2025, 1, 1), "web", 1, None, "L"), ("O2", "C1", "S2", None, "web", 1, None, "L"), ("O2", "C1", "S2", D(2025, 1, 1), "app", 1, None, "L")], ORDERS)
    tickets = spark.createDataFrame([("1", "O1", "C1", "S1", "x"), ("2", None, "C1", "S1", "y"), ("3", None, "C1", "S2", None), ("4", "O2", None, "S2", None)], "ticket_id string, order_id string, customer_id string, product_sku string, agrees string")
    joined = link._with_order_candidates(tickets, orders)
    assert not {"customer_id", "sku"} & {*joined.schema["direct"].dataType.names, *joined.schema["pair"].dataType.names}
    got = sorted((r["ticket_id"], r["order_match_method"], r["order_channel"] or "", r["agrees"]) for r in link.link_orders_checked(tickets, orders).collect())
    assert got == [
        ("1", "direct_order_id", "web", "x"), ("2", "unique_customer_sku", "web", "y"), ("3", "multiple_customer_sku_orders", "", None),
        ("4", "direct_order_id", "app", None), ("4", "direct_order_id", "web", None),
    ]


def contact(i, created, resolved, customer="C", order="O", sku="S"):
    return (str(i), created, resolved, customer, order, sku)


CONTACTS = "ticket_id string, created_at timestamp, resolved_at timestamp, customer_id string, order_id string, product_sku string"


def repeats(spark, rows, **options):
    df = link.detect_repeat_contacts(spark.createDataFrame(rows, CONTACTS), **options)
    return {r["ticket_id"]: r["repeat_contact_prior_ticket_id"] for r in df.collect()}


@pytest.mark.parametrize("block_hours", [1, 24, 24 * 365])
def test_repeat_contact_rules(spark, block_hours):
    d = lambda n, h=0: T(2025, 1, 1) + dt.timedelta(days=n, hours=h)
    rows = [
        contact(1, d(0), d(1)),
        contact(2, d(5), d(6)),
        contact(3, d(6), d(7)),  # created when 2 is resolved: only 1 precedes
        contact(4, d(60), None),  # outside the window
        contact(5, d(5), d(5), customer="other"),
        contact(6, d(8), d(9), order=None),
        contact(7, d(10), d(7, 1), order=None),  # resolved before its own creation, and before 6 is created
        contact(8, d(11), None, order=None, sku=None),
        contact(9, None, d(7)),  # ties with 3 on resolution, larger id wins
        contact(10, d(12), None),
        contact(11, d(30), d(12), customer="self"),  # only its own resolution precedes
        contact(12, d(0), d(1), customer="late"),
        contact(13, d(10), d(5), customer="late"),  # its own resolution is the latest before its creation; 12 comes next
    ]
    got = repeats(spark, rows, block_hours=block_hours)
    assert got == {
        "1": None, "2": "1", "3": "1", "4": None, "5": None, "6": "7", "7": "6", "8": None, "9": None, "10": "9", "11": None,
        "12": None, "13": "12",
    }


def test_repeat_contact_reasons(spark):
    df = link.detect_repeat_contacts(spark.createDataFrame([contact(1, None, None), contact(2, T(2025, 1, 1), None, order="", sku="")], CONTACTS))
    got = {r["ticket_id"]: r["repeat_contact_candidate_reason"] for r in df.collect()}
    assert got == {"1": "missing_created_at_or_customer_id", "2": "missing_order_and_product_sku"}
    with pytest.raises(ValueError, match="needs 1"):
        link.detect_repeat_contacts(df, 0)


def test_one_hot_key_is_spread_over_blocks(spark):
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("ticket_id"),
        F.timestamp_seconds(F.col("id") * 3600).alias("created_at"),
        F.timestamp_seconds(F.col("id") * 3600 + 5400).alias("resolved_at"),
        F.lit("C").alias("customer_id"),
        F.lit("O").alias("order_id"),
        F.lit("S").alias("product_sku"),
    )
    rows = link.detect_repeat_contacts(df).select("ticket_id", "repeat_contact_prior_ticket_id").collect()
    assert all(p == (str(int(t) - 2) if int(t) >= 2 else None) for t, p in rows)


def test_repeat_contacts_equal_a_plain_scan(spark):
    """Random contacts with ties, own resolutions before creation, null times and ids, against every pair."""
    rng = random.Random(7)
    at = lambda h: T(2025, 1, 1) + dt.timedelta(hours=h)
    rows = []
    for i in range(700):
        created = None if rng.random() < 0.05 else at(rng.randint(0, 900))
        resolved = None if rng.random() < 0.2 else at(rng.randint(0, 900))
        rows.append(contact(i, created, resolved, rng.choice(["C", "C", "C", "D", None, ""]), rng.choice(["O", "O", None, ""]), rng.choice(["S", "T", None])))
    key = lambda r: (r[3] or None, bool(r[4]), r[4] or r[5] or None)
    want = {}
    for i, created, _, *_rest in rows:
        own = key(rows[int(i)])
        if created is None or None in (own[0], own[2]):
            want[i] = None
            continue
        prior = [(r[2], r[0]) for r in rows if r[2] is not None and r[2] < created and r[0] != i and key(r) == own]
        best = max(prior, default=None)
        want[i] = best[1] if best and created - best[0] <= dt.timedelta(days=3) else None
    for hours in (1, 24, 5000):
        assert repeats(spark, rows, window_days=3, block_hours=hours) == want
    again = spark.createDataFrame(rows + rows[:50] + [(None, at(1), at(2), "C", "O", "S")] * 2, CONTACTS)
    assert link.detect_repeat_contacts(again).count() == 752 == link.repeat_contact_flags(again).count()


def test_repeat_contacts_scan_the_input_once(spark, tmp_path):
    rows = [contact(i, T(2025, 1, 1), T(2025, 1, 2)) for i in range(20)]
    spark.createDataFrame(rows, CONTACTS).write.parquet(f"{tmp_path}/t")
    flags = link.repeat_contact_flags(spark.read.parquet(f"{tmp_path}/t"))
    flags.collect()
    plan = flags._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and final.count("Exchange hashpartitioning") <= 3 and "Join" not in final


def test_only_tickets_that_share_their_key_are_scanned(spark, monkeypatch):
    """Tickets alone with their key, and those without one, have no match; they get their columns without the scan."""
    day = lambda i: T(2025, 1, i)
    rows = [contact(i, day(2), day(3), order=f"O{i}") for i in range(50)]
    rows += [contact("a", day(1), day(2), order="P"), contact("b", day(4), day(5), order="P"), contact("b", day(4), day(5), order="P"), contact("c", day(4), None, customer=None), contact(None, day(6), None, order="P")]
    seen, scan = [], link._repeat_matches

    def counted(base, *rest):
        seen.append(base.count())
        return scan(base, *rest)

    monkeypatch.setattr(link, "_repeat_matches", counted)
    got = [tuple(r) for r in link.detect_repeat_contacts(spark.createDataFrame(rows, CONTACTS)).select("ticket_id", "repeat_contact_candidate_flag", "repeat_contact_prior_ticket_id", "repeat_contact_match_method", "repeat_contact_candidate_reason").collect()]
    assert seen == [4] and len(got) == len(rows)
    hit = ("customer_order_id", "same_customer_issue_proxy_within_30_days")
    assert [r for r in got if r[1]].count(("b", True, "a", *hit)) == 2
    assert ("c", False, None, None, "missing_created_at_or_customer_id") in got and ("7", False, None, None, "no_qualifying_prior_contact") in got


def test_money_of_tickets_matched_before(spark):
    """Products and repeat contacts joined to the raw tickets give the same as joined to rows with metrics, and are joined once."""
    from decimal import Decimal

    goods = spark.createDataFrame([("S", "F", Decimal("1000")), ("S", "F", Decimal("1000")), ("N", "G", None)], "sku string, family string, unit_cost_inr decimal(18,2)")
    rows = [(str(i), T(2025, 1, i + 1), T(2025, 1, i + 1, 5), "C", "O", "SN"[i % 2], "chat", "YNy"[i % 3], None, 1, False, True) for i in range(6)]
    raw = spark.createDataFrame([*rows, rows[2]], CONTACTS + ", channel string, replacement_issued string, refund_amount_inr decimal(18,2), transfers_numeric int, sla_breach_flag boolean, valid_for_sla boolean")
    late = economics.calculate_ticket_economics(raw, goods)
    first = economics.with_replacement_product(link.detect_repeat_contacts(raw), goods)
    early = economics.calculate_ticket_economics(first, goods)
    shown = sorted(late.columns)
    assert sorted(early.columns) == shown
    assert sorted(map(str, early.select(shown).collect())) == sorted(map(str, late.select(shown).collect()))
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(early) == joins(first)


def test_peer_group_fallbacks(spark):
    table = roster(spark, *[(f"A{i}", "x", "T1", D(2025, 1, 1), None) for i in range(3)], ("B0", "y", "T1", D(2025, 1, 1), None), ("C0", "x", "T2", D(2025, 1, 1), None), ("A0", "x", "T1", D(2026, 1, 1), None))
    got = {(r["agent_id"], r["agent_from_date"]): (r["comparison_group"], r["peer_fallback_level"], r["peer_agent_count"]) for r in peers.build_peer_groups(table).collect()}
    first = D(2025, 1, 1)
    assert got[("A0", first)] == ("tier=T1|team=x|site=s|shift=day", "tier_team_site_shift", 3) == got[("A0", D(2026, 1, 1))]
    assert got[("B0", first)] == ("tier=T1", "tier_only", 4)
    assert got[("C0", first)] == (None, "insufficient_peers", 0)


def test_stability_equals_all_pairs(spark):
    key = ("a", "t", "1", "s", "d", None, None)
    cases = {"stable": [(0, 2), (1, 3), (1.5, 5)], "moved": [(0, 2), (1, 3), (2.5, 5)], "single": [(0, 1)]}
    rows = [(name, *key[1:], "quarter", f"q{i}", "csat", 5, (lo + hi) / 2, float(lo), float(hi)) for name, spans in cases.items() for i, (lo, hi) in enumerate(spans)]
    df = spark.createDataFrame(rows, "agent_id string, agent_team string, agent_tier string, agent_site string, agent_shift string, agent_from_date date, agent_to_date date, period_type string, period string, outcome string, eligible_count int, mean double, ci_lower double, ci_upper double")
    got = {r["agent_id"]: r["stability_flag"] for r in stability.assess_stability(df).collect()}
    assert got == {"stable": "no_clear_shift_detected", "moved": "variable_across_quarters", "single": "insufficient_period_evidence"}


ECON = "ticket_id string, channel string, product_sku string, replacement_issued string, refund_amount_inr decimal(18,2), transfers_numeric int, sla_breach_flag boolean, valid_for_sla boolean"


def test_ticket_economics(spark):
    from decimal import Decimal

    goods = spark.createDataFrame([("S", "F", Decimal("1000")), ("N", "F", None)], "sku string, family string, unit_cost_inr decimal(18,2)")
    rows = [("1", "chat", "S", "Y", Decimal("50"), 2, True, True), ("2", "Email ", "N", "y", None, None, None, None), ("3", "voice", "S", "N", None, 0, False, True)]
    got = {r["ticket_id"]: r for r in economics.ticket_economics(spark.createDataFrame(rows, ECON), goods).collect()}
    one = got["1"]
    assert [float(one[c]) for c in ("contact_cost_inr", "sla_breach_cost_inr", "transfer_cost_inr", "replacement_cost_inr", "refund_amount_inr", "total_relevant_exposure_inr")] == [210, 350, 610, 1340, 50, 2560]
    assert one["refund_replacement_anomaly_flag"] and float(one["refund_replacement_anomaly_exposure_inr"]) == 1390
    assert got["2"]["replacement_cost_inr"] is None and got["2"]["replacement_cost_missing_flag"] and float(got["2"]["total_relevant_exposure_inr"]) == 260
    assert float(got["3"]["replacement_cost_inr"]) == 0 and got["3"]["replacement_product_family"] is None


def test_strict_economics_rejects_unknown_channel(spark):
    goods = spark.createDataFrame([], "sku string, family string, unit_cost_inr decimal(18,2)")
    rows = spark.createDataFrame([("1", "fax", "S", "N", None, 0, False, True)], ECON)
    assert economics.ticket_economics(rows, goods).first()["economics_input_error_flag"]
    with pytest.raises(Exception, match="unsupported channel"):
        economics.ticket_economics(rows, goods, strict=True).collect()


def test_scenarios_reject_negative_exposure(spark):
    zero = {c: F.lit(100).cast("decimal(18,2)") for c in economics.DRIVERS.values()}
    rows = economics.opportunity_scenarios(spark.range(1).withColumns(zero))
    assert rows.count() == 18 and float(rows.agg(F.max("scenario_opportunity")).first()[0]) == 30
    with pytest.raises(Exception, match="negative exposure"):
        economics.opportunity_scenarios(spark.range(1).withColumns(zero | {"contact_cost_inr": F.lit(-1).cast("decimal(18,2)")})).collect()


def test_adjusted_overlay_appends_quarters(spark):
    full = spark.createDataFrame([("A", "full_available_period", 0.5, "comparable")], "agent_id string, period_type string, csat_gap double, comparison_status string")
    adjusted = spark.createDataFrame([("A", "quarter", 0.1, 3), ("A", "month", 0.2, 1), (None, "quarter", None, 2)], "agent_id string, period_type string, csat_gap double, tickets int")
    rows = {tuple(r) for r in link.adjusted_overlay(full, adjusted).collect()}
    assert rows == {("A", "full_available_period", 0.5, "comparable", None), ("A", "quarter", 0.1, None, 3), (None, "quarter", None, None, 2)}
