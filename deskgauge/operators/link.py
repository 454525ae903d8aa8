"""Linking tickets to rosters, orders, products and earlier tickets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskgauge.functions.keys import join_null_safe
from deskgauge.params import ASSIGNMENT


def guarded_left_join(
    fact: DataFrame, dim: DataFrame, fk: str, pk: str, prefix: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Many-to-one left join plus a one-row check of the relationship.

    The dimension is made unique by construction (one row per key), so the fact grain cannot grow even when the check
    reports duplicates; only columns that do not clash are added.
    """
    added = [c for c in dim.columns if c != pk and c not in fact.columns]
    unique = dim.groupBy(pk).agg(
        *[F.min_by(F.struct(*added), F.struct(*added)).alias("__dim")], F.count(F.lit(1)).alias("__copies")
    )
    named = unique.select(F.col(pk).alias("__pk"), *[F.col(f"__dim.{c}").alias(f"{prefix}{c}") for c in added])
    joined = fact.join(named, fact[fk] == F.col("__pk"), "left").drop("__pk")
    duplicates = dim.agg((F.count(pk) - F.count_distinct(pk)).alias("n")).scalar()
    orphans = (
        fact.filter(F.nullif(F.col(fk).cast("string"), F.lit("")).isNotNull())
        .join(dim.select(F.col(pk).alias("__pk")), fact[fk] == F.col("__pk"), "left_anti")
        .agg(F.count(F.lit(1)).alias("n"))
        .scalar()
    )
    checks = fact.sparkSession.range(1).select(
        duplicates.alias("duplicate_dimension_keys"),
        orphans.alias("orphan_rows"),
        F.when((duplicates == 0) & (orphans == 0), "PASS").otherwise("FAIL").alias("status"),
    )
    return joined, checks


# --- effective-dated roster ---------------------------------------------------------------------------------------
ROSTER_FIELDS = ("name", "site", "team", "shift", "tier", "from_date", "to_date")
OPEN_END = "9999-12-31"


def roster_segments(roster: DataFrame) -> DataFrame:
    """Cut each agent's intervals into disjoint segments ``[seg_from, seg_to)`` with the number of covering intervals.

    A segment covered once carries that interval's attributes. Because segments are disjoint, a ticket day meets at
    most one of them: the range join keeps the ticket grain without a per-ticket check, and an overlap shows up as
    ``roster_match_count > 1`` exactly on the tickets that fall into it.
    """
    usable = "agent_id is not null and from_date is not null and (to_date is null or to_date >= from_date)"
    rows = roster.filter(usable).select(
        "agent_id", F.struct(*[F.col(f) for f in ROSTER_FIELDS]).alias("attrs")
    )
    rows = rows.withColumn("rid", F.xxhash64("agent_id", F.to_json("attrs")).cast("decimal(20,0)"))
    end = F.date_add(F.coalesce("attrs.to_date", F.date_sub(F.lit(OPEN_END).cast("date"), 1)), 1)
    edges = rows.select(
        "agent_id",
        F.inline(
            F.array(
                F.struct(F.col("attrs.from_date").alias("day"), F.lit(1).alias("sign"), "rid"),
                F.struct(end.alias("day"), F.lit(-1).alias("sign"), "rid"),
            )
        ),
    )
    # one row per boundary day, so several intervals may start or end on it
    days = edges.groupBy("agent_id", "day").agg(
        F.sum("sign").alias("step"), F.sum(F.col("sign") * F.col("rid")).alias("rid_step")
    )
    line = Window.partitionBy("agent_id").orderBy("day")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    segments = days.select(
        "agent_id",
        F.col("day").alias("seg_from"),
        F.lead("day").over(line).alias("seg_to"),
        F.sum("step").over(upto).alias("cover"),
        F.sum("rid_step").over(upto).alias("rid"),
    ).filter("cover > 0 and seg_to is not null")
    named = rows.groupBy("agent_id", "rid").agg(F.first("attrs").alias("attrs"))
    return segments.join(named, ["agent_id", "rid"], "left").select(
        "agent_id", "seg_from", "seg_to", "cover", F.when(F.col("cover") == 1, F.col("attrs")).alias("attrs")
    )


def assign_roster(tickets: DataFrame, roster: DataFrame, timestamp: str = "resolved_at") -> DataFrame:
    """Attach the roster interval containing the ticket's UTC day; adds ``agent_*`` columns and the match label."""
    seg = roster_segments(roster).withColumnRenamed("agent_id", "__agent")
    day = F.to_date(F.col(timestamp))
    joined = tickets.join(
        seg,
        (F.col("agent_id") == F.col("__agent")) & (day >= F.col("seg_from")) & (day < F.col("seg_to")),
        "left",
    )
    label = (
        F.when(F.col("cover") == 1, "matched")
        .when(F.col("cover") > 1, "overlapping_roster")
        .when(F.col("agent_id").isNull() | F.col(timestamp).isNull(), "missing_agent_or_time")
        .otherwise("no_roster_interval")
    )
    return joined.select(
        *[tickets[c] for c in tickets.columns],
        *[F.col(f"attrs.{f}").alias(f"agent_{f}") for f in ROSTER_FIELDS],
        label.alias("agent_assignment_flag"),
        F.coalesce("cover", F.lit(0)).cast("bigint").alias("roster_match_count"),
    )


# --- order links --------------------------------------------------------------------------------------------------
def _pair_candidates(orders: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per (customer, sku): number of orders and, when there is exactly one, that order."""
    present = orders.filter(F.col("customer_id").isNotNull() & F.col("sku").isNotNull())
    return present.groupBy("customer_id", "sku").agg(
        F.count(F.lit(1)).alias("pair_orders"), F.min(F.struct(*fields)).alias("pair")
    )


#: What a link hands on of an order. Customer and product are compared where the order is met and don't travel further.
ORDER_FIELDS = ("order_id", "order_date", "channel", "qty", "order_value_inr", "lot_code")


def _spread(key: Column, row: Column) -> Column:
    """The join key, or where it is NULL one of many values that no table holds: such rows don't meet in one task."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(row), F.lit(4096)).cast("string")))


def _with_order_candidates(tickets: DataFrame, orders: DataFrame) -> DataFrame:
    """Adds the order with the ticket's id (``direct``) and whether customer and product agree with it (``__agrees``), else the
    (customer, sku) orders. Linked tickets look for no pair."""
    direct = orders.select(F.col("order_id").alias("__id"), F.col("customer_id").alias("__customer"), F.col("sku").alias("__sku"), F.struct(*ORDER_FIELDS).alias("direct"))
    pairs = _pair_candidates(orders, ORDER_FIELDS).withColumnsRenamed({"customer_id": "__c", "sku": "__s"})
    row, customer, sku = tickets["ticket_id"], tickets["customer_id"], tickets["product_sku"]
    looks = F.col("direct").isNull() & customer.isNotNull() & sku.isNotNull()
    agrees = (
        (customer.isNull() | customer.eqNullSafe(F.col("__customer")))
        & (sku.isNull() | sku.eqNullSafe(F.col("__sku")))
        & (customer.isNotNull() | sku.isNotNull())
    )
    joined = tickets.join(direct, _spread(tickets["order_id"], row) == F.col("__id"), "left")
    joined = joined.select(*[tickets[c] for c in tickets.columns], "direct", agrees.alias("__agrees"))
    return joined.join(pairs, (_spread(F.when(looks, customer), row) == F.col("__c")) & (F.coalesce(sku, F.lit("")) == F.col("__s")), "left")


def link_orders_basic(tickets: DataFrame, orders: DataFrame) -> DataFrame:
    """Order by id, else the unique (customer, sku) order. No conflict check; adds the match flag and order date."""
    joined = _with_order_candidates(tickets, orders)
    chosen = F.coalesce("direct", F.when(F.col("pair_orders") == 1, F.col("pair")))
    flag = (
        F.when(chosen.isNotNull(), "matched")
        .when(tickets["order_id"].isNull(), "missing_order_id")
        .otherwise("unmatched_order")
    )
    return joined.select(
        *[tickets[c] for c in tickets.columns],
        chosen["order_id"].alias("linked_order_id"),
        chosen["order_date"].alias("linked_order_date"),
        flag.alias("order_match_flag"),
    )


def link_orders_checked(tickets: DataFrame, orders: DataFrame) -> DataFrame:
    """Order link that refuses conflicting evidence; one row per ticket with status and method."""
    joined = _with_order_candidates(tickets, orders)
    found, agrees = F.col("direct").isNotNull(), F.col("__agrees")
    single = F.coalesce(F.col("pair_orders") == 1, F.lit(False))
    several = F.coalesce(F.col("pair_orders") > 1, F.lit(False))
    method = (
        F.when(found & agrees, "direct_order_id")
        .when(found, "conflicting_direct_order_id")
        .when(single, "unique_customer_sku")
        .when(several, "multiple_customer_sku_orders")
    )
    status = (
        F.when(method.isin("direct_order_id", "unique_customer_sku"), "matched")
        .when(method.isNotNull(), "ambiguous")
        .otherwise("unmatched")
    )
    chosen = F.when(found & agrees, F.col("direct")).when(~found & single, F.col("pair"))
    return joined.select(
        *[tickets[c] for c in tickets.columns if c != "order_id"],
        tickets["order_id"].alias("source_order_id"),
        chosen["order_id"].alias("order_id"),
        status.alias("order_match_status"),
        method.alias("order_match_method"),
        chosen["channel"].alias("order_channel"),
        chosen["lot_code"].alias("order_lot_code"),
        chosen["order_date"].alias("order_date"),
        chosen["qty"].alias("order_quantity"),
        chosen["order_value_inr"].alias("order_value_inr"),
    )


def add_product_family(tickets: DataFrame, products: DataFrame) -> DataFrame:
    lookup = products.select(F.col("sku").alias("__sku"), F.col("family").alias("product_family"))
    return tickets.join(lookup, F.col("product_sku") == F.col("__sku"), "left").drop("__sku")


def attach_peer_groups(tickets: DataFrame, peer_groups: DataFrame) -> DataFrame:
    """Null-safe composite join on the assignment columns, for roster-matched tickets only."""
    fields = ("comparison_group", "peer_fallback_level", "peer_agent_count", "peer_supported")
    # one row per assignment: a roster listing the same assignment twice describes the same peers
    groups = peer_groups.select(*ASSIGNMENT, *fields).dropDuplicates(list(ASSIGNMENT))
    packed = groups.select(F.col("agent_id").alias("__agent"), F.struct(*ASSIGNMENT[1:], *fields).alias("__named"))
    nobody = packed.filter("__agent is null").agg(F.collect_list("__named").alias("__nobody")).filter("size(__nobody) > 0")
    matched = F.col("agent_assignment_flag") == "matched"

    def same(group: Column) -> Column:
        found = F.lit(True)
        for k in ASSIGNMENT[1:]:
            # not <=>, which would be a join key: tickets that were dealt by agent for the roster stay where they are
            found = found & F.coalesce(tickets[k] == group[k], tickets[k].isNull() & group[k].isNull())
        return found

    own = (tickets["agent_id"] == F.col("__agent")) & matched & same(F.col("__named"))
    joined = tickets.join(packed.filter("__agent is not null"), own, "left")
    joined = joined.join(nobody, tickets["agent_id"].isNull(), "left")  # one row or none
    unnamed = F.when(matched, F.get(F.filter("__nobody", same), F.lit(0)))
    joined = joined.withColumn("__group", F.coalesce("__named", unnamed))
    joined = joined.withColumns({f"__g_{f}": F.col("__group")[f] for f in fields})
    return joined.select(
        *[tickets[c] for c in tickets.columns],
        F.col("__g_comparison_group").alias("comparison_group"),
        F.coalesce("__g_peer_fallback_level", F.lit("unmatched_context")).alias("peer_fallback_level"),
        F.coalesce("__g_peer_agent_count", F.lit(0)).alias("peer_agent_count"),
        F.coalesce("__g_peer_supported", F.lit(False)).alias("peer_supported"),
    )


# --- repeat contacts ----------------------------------------------------------------------------------------------
REPEAT_COLUMNS = ("candidate_flag", "prior_ticket_id", "match_method", "candidate_reason")


def _contact_keys(tickets: DataFrame, id_col: str) -> list[Column]:
    """id, k1 (customer), k2 (method), k3 (order or product), created: what a ticket's match depends on."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    order, sku = blank("order_id"), blank("product_sku")
    method = F.when(order.isNotNull(), "customer_order_id").when(sku.isNotNull(), "customer_product_sku_fallback")
    return [
        F.col(id_col).cast("string").alias("id"),
        blank("customer_id").cast("string").alias("k1"),
        method.alias("k2"),
        F.coalesce(order, sku).cast("string").alias("k3"),
        F.col("created_at").cast("timestamp").alias("created"),
    ]


def _contacts(tickets: DataFrame, id_col: str) -> DataFrame:
    return tickets.select(*_contact_keys(tickets, id_col), F.col("resolved_at").cast("timestamp").alias("resolved"))


def _in_company(contacts: DataFrame) -> DataFrame:
    """The contacts whose key another one shares: no other has a match. Equal hashes of unequal keys only let more rows pass."""
    keyed = contacts.where("k1 is not null and k2 is not null").withColumn("__key", F.xxhash64("k1", "k2", "k3"))
    several = keyed.groupBy(F.col("__key").alias("__of")).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
    return keyed.join(several, F.col("__key") == F.col("__of"), "left_semi").drop("__key")


def _repeat_reason(hit: Column, k1: Column, k2: Column, created: Column, window_days: int) -> Column:
    return (
        F.when(created.isNull() | k1.isNull(), "missing_created_at_or_customer_id")
        .when(k2.isNull(), "missing_order_and_product_sku")
        .when(hit, f"same_customer_issue_proxy_within_{window_days}_days")
        .otherwise("no_qualifying_prior_contact")
    )


def _repeat_matches(base: DataFrame, window_days: int, block_hours: int) -> DataFrame:
    """id, k1, k2, k3, created and the four result columns, one row per row of ``base`` (see ``_contacts``).

    A segmented prefix scan: each ticket becomes its creation and its resolution by one explode, and these few columns are
    sorted by (key, time block). The last row of each block holds the block's last two resolutions; only these rows meet along a
    key, learn what earlier blocks leave behind, and hand it down to their block. So there is one scan of the input, three
    exchanges, no join, and a key that holds a large part of all tickets is spread over its blocks. Two resolutions are
    handed on because a ticket is never its own predecessor.
    """
    if window_days <= 0:
        raise ValueError(f"window_days is {window_days}, needs 1 or more")
    keyed = F.col("k1").isNotNull() & F.col("k2").isNotNull()
    span = block_hours * 3600 * 1000000
    block = lambda ts: F.floor(F.unix_micros(ts) / F.lit(span)).cast("bigint")
    # tickets without a key or creation match nothing and pass through, dealt out by id
    apart = F.pmod(F.xxhash64("id", "created"), F.lit(4096)).cast("bigint")
    linked = keyed & F.col("created").isNotNull()
    own = F.struct(F.when(linked, 0).otherwise(2).alias("kind"), F.col("created").alias("at"), F.when(linked, block(F.col("created"))).otherwise(apart).alias("block"))
    ending = F.when(keyed & F.col("resolved").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("resolved").alias("at"), block(F.col("resolved")).alias("block")))
    events = base.select("id", "k1", "k2", "k3", "created", F.explode(F.array_compact(F.array(own, ending))).alias("e")).select("id", "k1", "k2", "k3", "created", "e.*")

    key = ["k1", "k2", "k3"]
    inside = Window.partitionBy(*key, "block").orderBy(F.col("at").asc_nulls_first(), "kind", F.col("id").asc_nulls_first())
    earlier, so_far = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("res", F.when(F.col("kind") == 1, F.struct("at", "id")))
    # creations sort before resolutions of the same instant, so equal times do not match
    seen = seen.withColumn("previous", F.last("res", True).over(earlier)).withColumn("closes", F.lead("kind").over(inside).isNull())
    seen = seen.withColumn("two", F.last(F.when(F.col("res").isNotNull(), F.struct(F.col("res").alias("one"), F.col("previous").alias("other"))), True).over(so_far))

    seen = seen.withColumn("lane", F.when(~F.col("closes"), F.col("block")))
    along = Window.partitionBy(*key, "lane").orderBy("block")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    left = seen.withColumn("older", F.last("two.one", True).over(past))
    handed = F.when(F.col("two").isNotNull(), F.struct(F.col("two.one").alias("one"), F.coalesce("two.other", "older").alias("other")))
    left = left.withColumn("carry", F.when(F.col("closes"), F.last(handed, True).over(past)))

    whole = Window.partitionBy(*key, "block")
    known = left.where((F.col("kind") != 1) | F.col("closes")).withColumn("carry", F.max("carry").over(whole)).where("kind <> 1")
    first = F.coalesce("two.one", "carry.one")
    second = F.when(F.col("two").isNull(), F.col("carry.other")).otherwise(F.coalesce("two.other", "carry.one"))
    best = F.when(F.coalesce(first["id"] == F.col("id"), F.lit(False)), second).otherwise(first)
    found = known.select("id", *key, "created", "kind", best.alias("best"))
    near = F.unix_micros("created") - F.unix_micros("best.at") <= F.lit(window_days * 86400 * 1000000)
    hit = (F.col("kind") == 0) & F.coalesce(near, F.lit(False))
    reason = _repeat_reason(hit, F.col("k1"), F.col("k2"), F.col("created"), window_days)
    results = (hit, F.when(hit, F.col("best.id")), F.when(hit, F.col("k2")), reason)
    return found.select("id", *key, "created", *[r.alias(f"repeat_contact_{n}") for n, r in zip(REPEAT_COLUMNS, results, strict=True)])


def repeat_contact_flags(tickets: DataFrame, window_days: int = 30, block_hours: int = 24, id_col: str = "ticket_id") -> DataFrame:
    """The result columns of ``detect_repeat_contacts`` by ticket id only, one row per ticket."""
    found = _repeat_matches(_contacts(tickets, id_col), window_days, block_hours)
    return found.select(F.col("id").cast(tickets.schema[id_col].dataType).alias(id_col), *[f"repeat_contact_{n}" for n in REPEAT_COLUMNS])


def detect_repeat_contacts(
    tickets: DataFrame, window_days: int = 30, block_hours: int = 24, id_col: str = "ticket_id"
) -> DataFrame:
    """Latest earlier resolution of the same customer and order (or product) within ``window_days`` before creation.

    Only ids, keys and times of tickets that share their key go through the scan (see ``_repeat_matches``), and only its hits are
    joined back: what other tickets show follows from their own columns. A ticket is never its own predecessor; rows that agree in id,
    key and creation have the same match.
    """
    hits = _repeat_matches(_in_company(_contacts(tickets, id_col)), window_days, block_hours).where("repeat_contact_candidate_flag")
    keys = ("id", "k1", "k2", "k3", "created")
    hits = hits.dropDuplicates(list(keys)).withColumnsRenamed({k: f"__match_{k}" for k in keys})
    own = dict(zip(keys, _contact_keys(tickets, id_col), strict=True))
    same = own["id"].eqNullSafe(F.col("__match_id"))
    for k in keys[1:]:  # never null in a hit; expressions of the tickets' own columns, which don't travel beside them
        same = same & (own[k] == F.col(f"__match_{k}"))
    hit = F.coalesce("repeat_contact_candidate_flag", F.lit(False))
    reason = _repeat_reason(hit, own["k1"], own["k2"], own["created"], window_days)
    values = (hit, F.col("repeat_contact_prior_ticket_id"), F.col("repeat_contact_match_method"), reason)
    joined = tickets.join(hits, same, "left")
    return joined.select(*[tickets[f"`{c}`"] for c in tickets.columns], *[v.alias(f"repeat_contact_{n}") for n, v in zip(REPEAT_COLUMNS, values, strict=True)])


# --- overlays -----------------------------------------------------------------------------------------------------
def overlay(base: DataFrame, *later: DataFrame, key: str = "ticket_id") -> DataFrame:
    """One-to-one inner joins on ``key``; on a column clash the later table wins."""
    result = base
    for other in later:
        kept = [c for c in result.columns if c == key or c not in other.columns]
        result = result.select(*kept).join(other, key)
    return result


def adjusted_overlay(comparison: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Full-period comparison rows with the quarter rows of the adjusted metrics appended; columns that only one side has are
    null on the other, so decisions read gaps of both from one table."""
    return comparison.unionByName(adjusted.filter(F.col("period_type") == "quarter"), allowMissingColumns=True)


def first_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key under a total order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__rn", rank).filter("__rn = 1").drop("__rn")


def review_context(tickets: DataFrame, metrics: DataFrame, economics: DataFrame, comparison: DataFrame) -> DataFrame:
    """Ticket, metric and money columns on one row, with the agent's full-period adjusted gaps."""
    full = comparison.filter((F.col("period_type") == "full_available_period") & F.col("agent_id").isNotNull())
    gaps = first_per_key(full, "agent_id", [F.col("agent_from_date"), F.col("agent_to_date")]).select(
        "agent_id", *[F.col(f"{o}_gap").alias(f"peer_adjusted_{o}_gap") for o in ("csat", "handle_time", "sla")]
    )
    rows = overlay(tickets, metrics, economics)
    return join_null_safe(rows, gaps, ["agent_id"])


def keep_known_references(
    rows: DataFrame, id_array: str, analysed: DataFrame, canonical: DataFrame, row_key: str, id_col: str = "ticket_id"
) -> DataFrame:
    """Keep array elements present in both id tables, in order; count what was removed."""
    known = analysed.select(id_col).distinct().join(canonical.select(id_col).distinct(), id_col, "left_semi")
    cited = rows.select(row_key, F.posexplode(id_array).alias("pos", id_col))
    kept = cited.join(known, id_col, "left_semi").groupBy(row_key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", id_col))), lambda s: s[id_col]).alias("__kept")
    )
    joined = join_null_safe(rows, kept, [row_key])
    empty = F.array().cast(rows.schema[id_array].dataType)
    cleaned = F.coalesce("__kept", empty)
    return joined.withColumns(
        {
            id_array: cleaned,
            "removed_reference_count": (F.greatest(F.size(F.coalesce(id_array, empty)), F.lit(0)) - F.size(cleaned)).cast("bigint"),
        }
    ).drop("__kept")


def unambiguous_name(rows: DataFrame, roster: DataFrame, key: str = "agent_id", name: str = "name") -> DataFrame:
    """Attach a name only where the roster knows exactly one."""
    label = F.trim(F.col(name))
    names = (
        roster.filter(F.col(key).isNotNull() & (label != ""))
        .groupBy(key)
        .agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
        .filter("lo = hi")
        .select(key, F.col("lo").alias("agent_name"))
    )
    return rows.join(names, key, "left")


def agent_view(priority: DataFrame, comparison: DataFrame, economics: DataFrame, metrics: DataFrame,
               diagnostics: DataFrame | None = None) -> DataFrame:
    """Presentation row per agent: full-period comparison, metrics, money and decision, optional diagnostics."""
    full = comparison.filter(F.col("period_type") == "full_available_period")
    view = overlay(full, metrics, economics, priority, key="agent_id")
    if diagnostics is None:
        return view
    packed = diagnostics.select(
        "agent_id", F.struct(*[c for c in diagnostics.columns if c != "agent_id"]).alias("diagnostics")
    )
    return view.join(packed, "agent_id", "left")


def id_set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many ids each side has that the other lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only_left = a.join(b, key, "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    only_right = b.join(a, key, "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    return left.sparkSession.range(1).select(only_left.alias("only_left"), only_right.alias("only_right"))


def label_predictions(
    labels: DataFrame, predictions: DataFrame, selected: DataFrame, provider_available: bool = True
) -> DataFrame:
    """Status of each labelled ticket: scored, not_analyzed, not_run or not_selected."""
    joined = labels.join(
        selected.select("ticket_id", F.lit(True).alias("__selected")).distinct(), "ticket_id", "left"
    ).join(predictions.select("ticket_id", "predicted_label"), "ticket_id", "left")
    status = (
        F.when(F.col("predicted_label").isNotNull(), "scored")
        .when(F.col("__selected").isNull(), "not_selected")
        .when(F.lit(not provider_available), "not_run")
        .otherwise("not_analyzed")
    )
    return joined.withColumn("evaluation_status", status).drop("__selected")


def filter_view(df: DataFrame, selections: Mapping[str, Sequence[str]], query: str = "", id_col: str = "agent_id"):
    """Multi-column membership filter with an explicit bucket for missing values, plus an id substring."""
    for column, allowed in selections.items():
        shown = F.coalesce(F.col(column).cast("string"), F.lit("Unavailable"))
        df = df.filter(shown.isin(*allowed) if allowed else F.lit(False))
    needle = query.strip().lower()
    return df.filter(F.lower(F.col(id_col)).contains(needle)) if needle else df
