"""Tier-safe peer pools and leave-one-agent-out adjustment for work mix.

No ticket is ever joined with a ticket. Facts collapse once into fine cells (assignment x work mix x month) holding
count, sum and sum of squares per outcome; pool cells are sums of those, and leaving an agent out is a subtraction.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from deskgauge.functions import intervals
from deskgauge.functions.keys import FULL_PERIOD, PERIOD, join_null_safe, pool_label
from deskgauge.params import ASSIGNMENT, OUTCOMES, Outcome, PeerSpec

# --- fixed values: pool hierarchy and work-mix strata, finest first -----------------------------------------------
POOLS = (
    ("tier_team_site_shift", ("agent_tier", "agent_team", "agent_site", "agent_shift")),
    ("tier_team", ("agent_tier", "agent_team")),
    ("tier_only", ("agent_tier",)),
)
STRATA = (
    "channel_priority_period_product",
    "channel_priority_period",
    "channel_priority",
    "channel",
    "peer_group_only",
)
NO_CELL = "no_supported_peer_cell"

# Cells are named by slice and stratum. A quarter slice needs no cells of its own for the strata whose key already holds
# the quarter, and within a quarter or a month the first two strata without product coincide.
_MIX = {"c": "channel", "p": "priority", "q": "reporting_quarter", "m": "reporting_month", "f": "product_family"}
_CELLS = {
    "a1": "cpqf", "a2": "cpq", "a3": "cp", "a4": "c", "a5": "",
    "q4": "cq", "q5": "q",
    "m1": "cpfm", "m2": "cpm", "m4": "cm", "m5": "m",
}
# the columns in which the totals of all kinds of cells are kept: quarter and month share one
_TOTAL_KEYS = {"c": "channel", "p": "priority", "qm": "time", "f": "family"}
_SLICES = {"all": (FULL_PERIOD, None), "quarter": ("quarter", "reporting_quarter"), "month": ("month", "reporting_month")}
#: Agents of a pool in one part, and the number of parts that all pools are dealt over.
PART_AGENTS = 512
PARTS = 4096
_LOOKUPS = {
    "all": ((1, "a1"), (2, "a2"), (3, "a3"), (4, "a4"), (5, "a5")),
    "quarter": ((1, "a1"), (2, "a2"), (4, "q4"), (5, "q5")),
    "month": ((1, "m1"), (2, "m2"), (4, "m4"), (5, "m5")),
}
_PEER_FIELDS = ("comparison_group", "peer_fallback_level", "peer_agent_count", "peer_supported")


def build_peer_groups(roster: DataFrame, spec: PeerSpec = PeerSpec()) -> DataFrame:
    """First pool with enough distinct agents, from tier+team+site+shift over tier+team to tier; tier never crosses."""
    a = roster.select(
        "agent_id",
        F.col("team").alias("agent_team"),
        F.col("tier").alias("agent_tier"),
        F.col("site").alias("agent_site"),
        F.col("shift").alias("agent_shift"),
        F.col("from_date").alias("agent_from_date"),
        F.col("to_date").alias("agent_to_date"),
    )
    sized = a
    for name, fields in POOLS:
        sizes = a.groupBy(*fields).agg(F.count_distinct("agent_id").alias(f"__n_{name}"))
        sized = join_null_safe(sized, sizes, fields)
    level, label, count = F.lit("insufficient_peers"), F.lit(None).cast("string"), F.lit(0).cast("bigint")
    for name, fields in reversed(POOLS):
        enough = F.col(f"__n_{name}") >= spec.min_agents
        level = F.when(enough, name).otherwise(level)
        label = F.when(enough, pool_label(*[F.col(f) for f in fields])).otherwise(label)
        count = F.when(enough, F.col(f"__n_{name}")).otherwise(count)
    return sized.select(
        *a.columns,
        label.alias("comparison_group"),
        level.alias("peer_fallback_level"),
        count.alias("peer_agent_count"),
        label.isNotNull().alias("peer_supported"),
        F.lit(spec.min_agents).cast("bigint").alias("minimum_peer_agents"),
    )


def pool_membership() -> Column:
    """The distinct pool labels of a supported row; empty for other rows."""
    labels = F.array_distinct(F.array(*[pool_label(*[F.col(f) for f in fields]) for _, fields in POOLS]))
    member = F.col("comparison_group").isNotNull() & F.col("peer_supported")
    return F.when(member, labels).otherwise(F.array().cast("array<string>"))


def _present(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("(missing)"))


def _fine_cells(rows: DataFrame, outcomes: Sequence[Outcome]) -> DataFrame:
    """One row per assignment x mix x month with count, sum and sum of squares of each outcome about its centre."""
    keys = [*ASSIGNMENT, *_PEER_FIELDS, *_MIX.values()]
    sums = [F.count(F.lit(1)).alias("tickets")]
    for o in outcomes:
        value = F.when(F.col(o.eligible), F.col(o.value).cast("double"))
        shift = value - F.lit(o.centre)
        sums += [F.count(value).alias(f"n_{o.name}"), *[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{p}_{o.name}") for p, x in (("s", shift), ("q", shift * shift))]]
    return rows.groupBy(*keys).agg(*sums)


def cell_lists(rows: DataFrame, outcomes: Sequence[Outcome] = OUTCOMES) -> DataFrame:
    """One row per assignment with the list of its fine cells, which a part holds at once anyway."""
    fine = _fine_cells(rows, outcomes)
    mix = {x: F.nullif(F.col(x), F.lit("")) for x in ("reporting_quarter", "reporting_month")}
    mix |= {x: _present(x) for x in ("channel", "priority", "product_family")}
    sums = [f"{p}_{o.name}" for o in outcomes for p in ("n", "s", "q")]
    cell = F.struct(*[mix[x].alias(x) for x in _MIX.values()], "tickets", *sums)
    return fine.groupBy(*ASSIGNMENT, *_PEER_FIELDS).agg(F.collect_list(cell).alias("cells"))


def cell_totals(lists: DataFrame, keys: Sequence[str], outcomes: Sequence[Outcome] = OUTCOMES) -> DataFrame:
    """Per key the tickets of :func:`cell_lists`, and count and sum of each outcome (not about its centre)."""
    cells = lists.select(*keys, F.explode("cells").alias("c"))
    sums = [F.sum("c.tickets").alias("tickets")]
    for o in outcomes:
        n = F.col(f"c.n_{o.name}")
        sums += [F.sum(n).alias(f"n_{o.name}"), F.sum(F.col(f"c.s_{o.name}") + n * F.lit(o.centre)).alias(f"sum_{o.name}")]
    return cells.groupBy(*keys).agg(*sums)


def _parts(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """The cell lists of each pool in use that an assignment belongs to or is compared with, with the part they fall into.

    A pool is divided by agent into ``buckets``, which are dealt over a fixed number of parts, so a part holds all cells
    of an agent in a pool and about as many agents whatever the sizes of the pools.
    """
    in_use = groups.filter("comparison_group is not null").groupBy(F.col("comparison_group").alias("pool"))
    pools = in_use.agg(F.ceil(F.max("peer_agent_count") / PART_AGENTS).alias("buckets"))
    labels = F.array_union(F.array("comparison_group"), pool_membership())
    rows = lists.withColumn("inside", F.array_contains(pool_membership(), F.col("comparison_group")))
    rows = rows.withColumn("pool", F.explode(labels)).join(pools, "pool", "left")
    focal = F.col("pool").eqNullSafe(F.col("comparison_group"))
    rows = rows.withColumns({"focal": focal, "member": F.col("buckets").isNotNull() & (F.coalesce("inside", F.lit(False)) | ~focal)})
    buckets = F.greatest(F.lit(1), F.least(F.col("buckets"), F.lit(PARTS))).cast("int")
    rows = rows.filter("focal or member").withColumn("buckets", buckets)
    agent = F.xxhash64("agent_id")
    part = F.when(F.col("pool").isNull(), F.pmod(agent, F.lit(PARTS))).otherwise(_part(F.pmod(agent, F.col("buckets"))))
    return rows.withColumn("part", part.cast("int")).drop("inside")


def _part(bucket: Column) -> Column:
    return F.pmod(F.xxhash64("pool") % PARTS + bucket, F.lit(PARTS))


def _moments(outcomes: Sequence[Outcome]) -> list[str]:
    return [f"{p}_{o.name}" for o in outcomes for p in ("n", "s", "q", "a")]


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _dense(*columns: pa.Array) -> tuple[np.ndarray, int]:
    """Numbers from 0 for the values of some columns, one behind the other."""
    found = pa.concat_arrays(columns).dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(found.dictionary))


def _combined(*columns: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    """Numbers for the combinations of some columns of such numbers; not all below the size need to occur."""
    code, size = columns[0]
    for other, width in columns[1:]:
        code, size = code * width + other, size * width
        if size > 2 * len(code) + 1024:
            code, size = _dense(pa.array(code))
    return code, size


def _numbered(*columns: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    """Numbers from 0, which all occur, for the combinations of some columns of numbers."""
    code, size = _combined(*columns)
    seen = np.zeros(size, bool)
    seen[code] = True
    return (np.cumsum(seen) - 1)[code], int(seen.sum())


def _cells_of(part: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The cells of all lists of a part, and the row of each."""
    lists = _column(part, "cells")
    owner = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return pa.Table.from_struct_array(lists.flatten()), owner


def _row_of(code: np.ndarray, size: int) -> np.ndarray:
    """Some row of each number."""
    rows = np.zeros(size, np.int64)
    rows[code] = np.arange(len(code))
    return rows


def _pool_totals(outcomes: Sequence[Outcome]):
    """Per part: count, sum, sum of squares and number of agents of each pool cell."""

    def run(part: pa.Table) -> pa.Table:
        part = part.filter(part.column("member"))
        if not len(part):
            return _empty(run.schema)
        cells, owner = _cells_of(part)
        agent, pool = (_of_cells(_dense(_column(part, name)), owner) for name in ("agent_id", "pool"))
        mix = {x: _dense(_column(cells, name)) for x, name in _MIX.items()}
        values = {f"{p}_{o.name}": _column(cells, f"{p}_{o.name}").to_numpy() for o in outcomes for p in ("n", "s", "q")}
        tables = []
        for kind, cell in enumerate(_CELLS.values()):
            code, size = _numbered(pool, *[mix[x] for x in cell])
            own, pairs = _combined((code, size), agent)
            of_pair, at = code[_row_of(own, pairs)], _row_of(code, size)
            rows = pa.array(owner[at])
            found = {"pool": part.column("pool").take(rows), "buckets": part.column("buckets").take(rows)}
            rows = pa.array(at)
            found["kind"] = pa.array(np.full(size, kind, np.int32))
            for x, name in _TOTAL_KEYS.items():
                held = next((c for c in cell if c in x), None)
                found[name] = cells.column(_MIX[held]).take(rows) if held else pa.nulls(size, pa.string())
            for o in outcomes:
                n = values[f"n_{o.name}"]
                some = np.bincount(own, n, pairs) > 0
                found[f"n_{o.name}"] = np.bincount(code, n, size).astype(np.int64)
                found[f"s_{o.name}"] = np.bincount(code, values[f"s_{o.name}"], size)
                found[f"q_{o.name}"] = np.bincount(code, values[f"q_{o.name}"], size)
                found[f"a_{o.name}"] = np.bincount(of_pair, some, size).astype(np.int64)
            names = ["pool", "buckets", "kind", *_TOTAL_KEYS.values(), *_moments(outcomes)]
            tables.append(pa.table({name: found[name] for name in names}))
        return pa.concat_tables(tables)

    return run


def _of_cells(numbers: tuple[np.ndarray, int], owner: np.ndarray) -> tuple[np.ndarray, int]:
    return numbers[0][owner], numbers[1]


def _empty(schema: StructType) -> pa.Table:
    return to_arrow_schema(schema).empty_table()


def _slice_sums(outcomes: Sequence[Outcome], spec: PeerSpec, keys: Sequence[str]):
    """Per part and its pool totals: the sums of :func:`adjusted_agent_metrics` per assignment and period.

    Own cells are subtracted from the pool's; a fine cell takes the first stratum that the rest supports.
    """

    def run(part: pa.Table, totals: pa.Table) -> pa.Table:
        compares = _column(part, "focal").to_numpy(zero_copy_only=False)
        if not compares.any():
            return _empty(run.schema)
        cells, owner = _cells_of(part)
        rows, focal = len(cells), np.flatnonzero(compares[owner])
        member = _column(part, "member").to_numpy(zero_copy_only=False).astype(np.float64)[owner]
        agent = _of_cells(_dense(_column(part, "agent_id")), owner)
        pools, width = _dense(_column(part, "pool"), _column(totals, "pool"))
        mix = {"pool": (np.concatenate([pools[: len(part)][owner], pools[len(part) :]]), width)}
        for x, name in _MIX.items():
            held = next(t for key, t in _TOTAL_KEYS.items() if x in key)
            mix[x] = _dense(_column(cells, name), _column(totals, held))
        own_values = {f"{p}_{o.name}": _column(cells, f"{p}_{o.name}").to_numpy() for o in outcomes for p in ("n", "s", "q")}
        pool_values = {m: _column(totals, m).to_numpy() for m in _moments(outcomes)}
        kinds = _column(totals, "kind").to_numpy()
        chosen = {
            (name, o.name): [np.zeros(len(focal), np.int8), np.zeros(len(focal)), np.zeros(len(focal))]
            for name in _LOOKUPS
            for o in outcomes
        }
        nobody = np.zeros(len(focal)), np.zeros(len(focal))
        whole = {key: nobody for key in chosen}
        # without members there is nothing to compare with
        for kind, (cell, parts) in enumerate(_CELLS.items() if member.any() else ()):
            there = np.flatnonzero(kinds == kind)
            at = np.concatenate([np.arange(rows), rows + there])
            code, size = _combined(*[(mix[x][0][at], mix[x][1]) for x in ("pool", *parts)])
            mine, pool_cell = code[:rows], code[rows:]
            # an agent's rows of a pool cell have the same peers, so these are found once
            pair, pairs = _numbered((mine, size), agent)
            here, own = mine[_row_of(pair, pairs)], pair[focal]
            known = np.bincount(pair, member, pairs) > 0
            uses = [(name, level) for name, tried in _LOOKUPS.items() for level, c in tried if c == cell]
            for o in outcomes:
                left = {}
                for p in ("n", "s", "q", "a"):
                    total = np.zeros(size)
                    total[pool_cell] = pool_values[f"{p}_{o.name}"][there]
                    left[p] = total[here]
                    if p != "a":
                        mine_of = np.bincount(pair, own_values[f"{p}_{o.name}"] * member, pairs)
                        left["a0"] = mine_of > 0 if p == "n" else left["a0"]
                        left[p] = left[p] - mine_of
                n, agents = left["n"], left["a"] - left["a0"]
                mean = left["s"] / np.maximum(n, 1)
                spread = np.maximum(left["q"] - n * mean * mean, 0.0)
                error = np.where(n > 1, spread / np.maximum(n - 1, 1), 0.0) / np.maximum(n, 1)
                enough = (known & (n >= spec.min_cell_observations) & (agents >= spec.min_cell_agents))[own]
                mean, error = mean[own], error[own]
                for name, level in uses:
                    first = enough & (chosen[name, o.name][0] == 0)
                    for held, value in zip(chosen[name, o.name], (level, mean, error), strict=True):
                        np.copyto(held, value, where=first, casting="unsafe")
                    if level == len(STRATA):
                        whole[name, o.name] = np.where(known, n, 0)[own], np.where(known, agents, 0)[own]
        asg = _of_cells(_numbered(*[_dense(_column(part, k)) for k in keys]), owner[focal])
        tickets = _column(cells, "tickets").to_numpy()[focal]
        tables = []
        for name, (kind, period) in _SLICES.items():
            shown = _column(cells, period).take(pa.array(focal)) if period else pa.repeat("all", len(focal))
            inside = np.flatnonzero(shown.is_valid().to_numpy(zero_copy_only=False))
            if not len(inside):
                continue
            when, width = _dense(shown)
            code, size = _numbered((asg[0][inside], asg[1]), (when[inside], width))
            at = inside[_row_of(code, size)]
            shows, rep = pa.array(owner[focal[at]]), pa.array(at)

            def add(values: np.ndarray, code=code, size=size, inside=inside) -> np.ndarray:
                return np.bincount(code, values[inside], size)

            def most(values: np.ndarray, code=code, size=size, inside=inside) -> np.ndarray:
                found = np.zeros(size)
                np.maximum.at(found, code, values[inside])
                return found.astype(np.int64)

            columns = [*[_column(part, k).take(shows) for k in keys], pa.array([kind] * size, pa.string()), shown.take(rep)]
            columns.append(pa.array(add(tickets).astype(np.int64)))
            for o in outcomes:
                n, s, q = (own_values[f"{p}_{o.name}"][focal] for p in ("n", "s", "q"))
                level, mean, error = chosen[name, o.name]
                matched = level > 0
                covered = add(n * matched).astype(np.int64)
                none = covered == 0
                columns += [pa.array(add(n).astype(np.int64)), pa.array(add(s)), pa.array(add(q)), pa.array(covered)]
                columns += [pa.array(add(v), mask=none) for v in (s * matched, q * matched, n * mean, n * error)]
                columns += [pa.array(most(v)) for v in whole[name, o.name]]
                columns += [pa.array(add(n * (level == i + 1)).astype(np.int64)) for i in range(len(STRATA))]
            tables.append(pa.Table.from_arrays(columns, names=run.schema.names))
        return pa.concat_tables(tables) if tables else _empty(run.schema)

    return run


def adjusted_agent_metrics(
    rows: DataFrame,
    spec: PeerSpec = PeerSpec(),
    outcomes: Sequence[Outcome] = OUTCOMES,
    peer_groups: DataFrame | None = None,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Observed minus leave-one-agent-out expected outcome per assignment and period slice.

    Every eligible ticket gets the mean of the first stratum with enough peer tickets from enough other agents;
    tickets without such a stratum count against coverage. ``peer_groups`` tells cheaply which pools are in use;
    without it they are read off the rows.

    The fine cells, as one list per assignment, are shuffled once, by parts of pools. Each part adds up its pool cells; those
    totals are summed over the parts of a pool and sent back to each of them, where own cells are subtracted. ``store`` writes
    the lists and reads them back: without it adaptive execution may plan their two readers differently, and facts are then
    read twice.
    """
    lists = cell_lists(rows, outcomes)
    lists = store(lists) if store else lists
    # both readers take all columns, so they share one shuffle
    parts = _parts(lists, lists if peer_groups is None else peer_groups)
    total_keys = ["pool", "buckets", "kind", *_TOTAL_KEYS.values()]
    types = {"n": "bigint", "s": "double", "q": "double", "a": "bigint"}
    measures = ", ".join(f"{m} {types[m[0]]}" for m in _moments(outcomes))
    shape = f"pool string, buckets int, kind int, {', '.join(f'{t} string' for t in _TOTAL_KEYS.values())}, {measures}"
    add = _pool_totals(outcomes)
    add.schema = StructType.fromDDL(shape)
    totals = parts.groupBy("part").applyInArrow(add, add.schema)
    totals = totals.groupBy(*total_keys).agg(*[F.sum(m).alias(m) for m in _moments(outcomes)])
    bucket = F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))
    totals = totals.withColumn("bucket", bucket).withColumn("part", _part(F.col("bucket")).cast("int")).drop("bucket")
    keys = [*ASSIGNMENT, *_PEER_FIELDS, *PERIOD]
    kept = StructType([f for f in parts.select(*ASSIGNMENT, *_PEER_FIELDS).schema.fields])
    sums = ["ticket_count bigint"]
    for o in outcomes:
        k = o.name
        sums += [f"n_{k} bigint", f"s_{k} double", f"q_{k} double", f"cov_{k} bigint"]
        sums += [f"{p}_{k} double" for p in ("sm", "qm", "exp", "evar")]
        sums += [f"{p}_{k} bigint" for p in ("peers", "agents", *[f"l{i}" for i in range(len(STRATA))])]
    rest = StructType.fromDDL(f"period_type string, period string, {', '.join(sums)}")
    compare = _slice_sums(outcomes, spec, [*ASSIGNMENT, *_PEER_FIELDS])
    compare.schema = StructType([*kept.fields, *rest.fields])
    found = parts.groupBy("part").cogroup(totals.groupBy("part")).applyInArrow(compare, compare.schema)
    return _estimates(found, keys, spec, outcomes)


def _estimates(sums: DataFrame, keys: Sequence[str], spec: PeerSpec, outcomes: Sequence[Outcome]) -> DataFrame:
    columns = [*[F.col(k) for k in keys], F.col("ticket_count")]
    for o in outcomes:
        k = o.name
        n, s, q, g = F.col(f"n_{k}"), F.col(f"s_{k}"), F.col(f"q_{k}"), F.lit(o.centre)
        cov, sm, qm, exp, evar = (F.col(f"{p}_{k}") for p in ("cov", "sm", "qm", "exp", "evar"))

        def sample_var(total, square, count):
            return F.when(count >= 2, F.greatest(square - total * total / count, F.lit(0.0)) / (count - 1))

        raw = F.when(n > 0, g + s / n)
        raw_se = F.sqrt(sample_var(s, q, n) / n)
        raw_low, raw_high = intervals.centre_and_error(raw, raw_se, o.bounds, spec.z)
        expected, gap = F.when(cov > 0, g + exp / cov), F.when(cov > 0, (sm - exp) / cov)
        gap_se = F.sqrt(sample_var(sm, qm, cov) / cov + evar / (cov * cov))
        low, high = intervals.centre_and_error(gap, gap_se, o.gap_bounds, spec.z)
        levels = F.array(*[F.struct(F.col(f"l{i}_{k}").alias("n"), F.lit(-i).alias("i")) for i in range(len(STRATA))])
        top = F.array_max(levels)
        name = F.element_at(F.array(*[F.lit(x) for x in STRATA]), F.lit(1) - top["i"])
        columns += [
            raw.alias(o.raw),
            expected.alias(o.peer),
            gap.alias(o.gap),
            n.alias(f"{k}_eligible_count"),
            F.col(f"peers_{k}").alias(f"{k}_peer_sample_size"),
            F.col(f"agents_{k}").alias(f"{k}_distinct_peer_count"),
            cov.alias(f"{k}_adjustment_coverage_count"),
            F.when(n > 0, cov / n).alias(f"{k}_adjustment_coverage_rate"),
            raw_se.alias(f"{k}_standard_error"),
            raw_low.alias(f"{k}_raw_ci_lower"),
            raw_high.alias(f"{k}_raw_ci_upper"),
            gap_se.alias(f"{k}_gap_standard_error"),
            low.alias(f"{k}_gap_ci_lower"),
            high.alias(f"{k}_gap_ci_upper"),
            intervals.direction(low, high).alias(f"{k}_gap_interval_direction"),
            F.when(cov > 0, F.sqrt(evar) / cov).alias(f"{k}_peer_mean_standard_error"),
            F.when(top["n"] > 0, name).otherwise(NO_CELL).alias(f"{k}_fallback_level"),
            intervals.evidence_label(n).alias(f"{k}_evidence_strength"),
        ]
    return sums.select(*columns)


def peer_group_summary(peer_groups: DataFrame) -> DataFrame:
    """Per comparison group: assignments, agents, fallback level and the tiers and teams it spans."""
    return (
        peer_groups.filter("comparison_group is not null")
        .groupBy("comparison_group")
        .agg(
            F.count(F.lit(1)).alias("selected_assignment_count"),
            F.max("peer_agent_count").alias("agent_count"),
            F.min("peer_fallback_level").alias("fallback_level"),
            F.sort_array(F.collect_set(F.coalesce("agent_tier", F.lit("None")))).alias("tiers"),
            F.sort_array(F.collect_set(F.coalesce("agent_team", F.lit("None")))).alias("teams"),
        )
    )


def agent_comparison(
    adjusted: DataFrame, stability: DataFrame, mix: DataFrame | None = None, outcomes: Sequence[Outcome] = OUTCOMES
) -> DataFrame:
    """Full-period rows with stability flags, comparison status and, when a mix is given, its JSON summary."""
    from deskgauge.operators.mix import case_mix_summary

    full = adjusted.filter(F.col("period_type") == FULL_PERIOD)
    flags = stability.groupBy(*ASSIGNMENT).agg(
        *[F.max(F.when(F.col("outcome") == o.name, F.col("stability_flag"))).alias(f"{o.name}_stability_flag") for o in outcomes]
    )
    rows = join_null_safe(full, flags, ASSIGNMENT)
    named = {
        f"{o.name}_stability_flag": F.coalesce(f"{o.name}_stability_flag", F.lit("insufficient_period_evidence"))
        for o in outcomes
    }
    rows = rows.withColumns(named)
    states = F.array(*[F.col(c) for c in named])
    covered = F.lit(False)
    for o in outcomes:
        covered = covered | (F.col(f"{o.name}_adjustment_coverage_count") > 0)
    rows = rows.withColumns(
        {
            "stability_flag": F.when(F.array_contains(states, "variable_across_quarters"), "variable_across_quarters")
            .when(F.forall(states, lambda s: s == "no_clear_shift_detected"), "no_clear_shift_detected")
            .otherwise("insufficient_period_evidence"),
            "comparison_status": F.when(F.col("peer_supported") & covered, "comparable")
            .when(F.col("peer_fallback_level") == "unmatched_context", "no_effective_assignment")
            .otherwise("insufficient_peer_support"),
        }
    )
    if mix is None:
        return rows
    rows = join_null_safe(rows, case_mix_summary(mix), ASSIGNMENT)
    return rows.withColumn("case_mix_summary", F.coalesce("case_mix_summary", F.lit("{}")))


def gap_summary(comparison: DataFrame, outcomes: Sequence[Outcome] = OUTCOMES) -> DataFrame:
    """Per outcome: counts by sign and direction, median absolute gap, coverage and low-evidence counts."""
    from deskgauge.operators.order_stats import exact_percentiles

    long = comparison.select(
        (F.col("comparison_status") == "comparable").alias("comparable"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(o.name).alias("outcome"),
                        F.col(o.gap).alias("gap"),
                        F.col(f"{o.name}_gap_interval_direction").alias("direction"),
                        F.col(f"{o.name}_adjustment_coverage_count").alias("coverage_count"),
                        F.col(f"{o.name}_adjustment_coverage_rate").alias("coverage_rate"),
                        F.col(f"{o.name}_eligible_count").alias("eligible_count"),
                    )
                    for o in outcomes
                ]
            )
        ),
    )
    gap, able = F.col("gap"), F.col("comparable")
    counts = long.groupBy("outcome").agg(
        F.count(gap).alias("adjusted_comparison_count"),
        F.count_if(gap > 0).alias("positive_gap_count"),
        F.count_if(gap < 0).alias("negative_gap_count"),
        F.count_if(gap == 0).alias("zero_gap_count"),
        *[
            F.count_if(gap.isNotNull() & (F.col("direction") == d)).alias(f"direction_{d}_count")
            for d in ("higher", "lower", "overlaps_zero", "insufficient")
        ],
        F.count_if(able & (F.col("coverage_count") > 0)).alias("assignments_with_any_coverage"),
        F.count_if(able & (F.col("coverage_count") == 0)).alias("zero_coverage_assignment_count"),
        F.avg(F.when(able, F.col("coverage_rate"))).alias("mean_coverage_rate"),
        F.min(F.when(able, F.col("coverage_rate"))).alias("minimum_coverage_rate"),
        F.count_if(able & (F.col("eligible_count") < 30)).alias("low_evidence_assignment_count"),
    )
    middle = exact_percentiles(
        long.withColumn("size", F.abs("gap")), ["outcome"], {"size": ("size", {"median_absolute_gap": 0.5})}
    )
    return counts.join(middle, "outcome", "left")


def fallback_histogram(comparison: DataFrame, outcomes: Sequence[Outcome] = OUTCOMES) -> DataFrame:
    """How often each stratum dominated, per outcome, over comparable rows."""
    levels = F.array(
        *[F.struct(F.lit(o.name).alias("outcome"), F.col(f"{o.name}_fallback_level").alias("level")) for o in outcomes]
    )
    rows = comparison.filter("comparison_status = 'comparable'").select(F.inline(levels))
    return rows.groupBy("outcome", "level").agg(F.count(F.lit(1)).alias("assignment_count"))


def low_evidence_agents(adjusted: DataFrame, floor: int = 30, outcomes: Sequence[Outcome] = OUTCOMES) -> DataFrame:
    """(scope, outcome, agent) below the evidence floor: in the full period, or in any month or quarter."""
    scope = F.when(F.col("period_type") == FULL_PERIOD, "full_period").otherwise("any_month_or_quarter")
    covered = F.lit(False)
    for o in outcomes:
        covered = covered | (F.col(f"{o.name}_adjustment_coverage_count") > 0)
    rows = adjusted.filter(
        F.col("comparison_group").isNotNull()
        & F.col("agent_id").isNotNull()
        & ((F.col("period_type") != FULL_PERIOD) | (F.col("peer_supported") & covered))
    )
    long = rows.select(
        scope.alias("scope"),
        "agent_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(o.name).alias("outcome"), F.col(f"{o.name}_eligible_count").alias("n"))
                    for o in outcomes
                ]
            )
        ),
    )
    return long.filter(F.col("n") < floor).select("scope", "outcome", "agent_id").distinct()
