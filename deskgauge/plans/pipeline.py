"""The staged end-to-end job: five raw tables in, validated, adjusted, costed and ranked tables out.

Every stage writes its tables below one folder and the next stage reads them back, so a lost executor or a restarted job
never recomputes more than one stage and lineage stays short. Only check rows reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskgauge.functions.times import parse_iso
from deskgauge.operators import (
    clean,
    decide,
    economics,
    link,
    metrics,
    mix,
    peers,
    products,
    profile,
    robust,
    stability,
    textreview,
    validate,
)
from deskgauge.params import DecisionConfig, PeerSpec, ServicePolicy
from deskgauge.sources import readers, sinks

MONEY = "decimal(18,2)"


@dataclass
class PipelineConfig:
    """Parameters of one run."""

    policy: ServicePolicy = field(default_factory=ServicePolicy)
    peers: PeerSpec = field(default_factory=PeerSpec)
    decisions: DecisionConfig = field(default_factory=DecisionConfig)
    text_limit: int | None = None
    selection_mode: str = "top_n"
    selection_size: int | None = None
    model: str = "unset"
    prompt_version: str = "v1"
    bootstrap_replicates: int = 80
    seed: int = 1701


class Pipeline:
    """Runs the stages in order; ``tables`` holds every written table by name."""

    def __init__(self, spark: SparkSession, folder: str, config: PipelineConfig | None = None):
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # naive times, roster days and months are those of UTC
        self.spark, self.folder, self.config = spark, folder, config or PipelineConfig()
        self.tables: dict[str, DataFrame] = {}

    def store(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        sinks.write_table(df, path)
        self.tables[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.tables[name]

    def run(self, raw: Mapping[str, DataFrame], predictions: DataFrame | None = None) -> dict[str, DataFrame]:
        """All seven stages. Failed checks of a stage stop the run before the next one starts."""
        self.ingest(raw)
        self.preprocess(raw)
        self.measure()
        self.compare()
        self.price()
        self.review(predictions)
        self.decide()
        self.evaluate()
        return self.tables

    # --- stage 1 ----------------------------------------------------------------------------------------------
    def ingest(self, raw: Mapping[str, DataFrame]) -> None:
        checks = validate.union_checks(
            *[
                validate.validate_table(
                    name, df, readers.CONTRACTS.get(name), readers.KEYS.get(name), readers.DATES.get(name, [])
                )
                for name, df in raw.items()
            ]
        )
        validate.assert_checks(self.store("source_checks", checks))
        for name, df in raw.items():
            self.store(f"profile_{name}", profile.inspect_table(df))

    def preprocess(self, raw: Mapping[str, DataFrame]) -> None:
        day = lambda c: F.to_date(parse_iso(F.col(c)))
        normal = {name: clean.normalize_table(df) for name, df in raw.items()}
        changes = [
            clean.normalization_changes(df, readers.KEYS.get(name, "agent_id")).withColumn("dataset", F.lit(name))
            for name, df in raw.items()
        ]
        self.store("normalization_changes", validate.union_checks(*changes))
        roster = self.store(
            "normalized_agents", normal["agents"].withColumns({c: day(c) for c in ("from_date", "to_date")})
        )
        customers = self.store(
            "normalized_customers", normal["customers"].withColumn("signup_date", day("signup_date"))
        )
        orders = self.store(
            "normalized_orders",
            normal["orders"].withColumns(
                {
                    "order_date": day("order_date"),
                    "qty": F.col("qty").try_cast("int"),
                    "order_value_inr": F.col("order_value_inr").try_cast(MONEY),
                }
            ),
        )
        goods = self.store(
            "normalized_products",
            normal["products"].withColumns(
                {
                    "launch_date": day("launch_date"),
                    "unit_cost_inr": F.col("unit_cost_inr").try_cast(MONEY),
                    "warranty_months": F.col("warranty_months").try_cast("int"),
                }
            ),
        )
        tickets = clean.repair_ticket_times(normal["tickets"], self.config.policy.zone)
        tickets = tickets.withColumn("refund_amount_inr", F.col("refund_amount_inr").try_cast(MONEY))
        tickets = clean.flag_message_quality(link.assign_roster(tickets, roster))
        tickets = clean.flag_date_anomalies(link.link_orders_basic(tickets, orders), customers, goods)
        tickets = self.store("normalized_tickets", clean.flag_duplicate_candidates(tickets))
        findings = validate.relationship_findings(
            {
                "customers": (customers, "customer_id", "customer_id"),
                "products": (goods, "sku", "product_sku"),
                "orders": (orders, "order_id", "order_id"),
            },
            "tickets",
            tickets,
        )
        self.store("relationship_findings", findings)
        flags = ["signup_anomaly_flag", "product_prelaunch_anomaly_flag", "reconciliation_flag"]
        audit = validate.stage_audit("normalized_tickets", tickets, "ticket_id", flags, raw["tickets"].count())
        overlaps = tickets.agg(F.count_if(F.col("roster_match_count") > 1).alias("n")).select(
            F.inline(F.array(validate.check_row("overlapping_roster", "agents", "agent_id", F.col("n"))))
        )
        validate.assert_checks(self.store("stage1_audit", validate.union_checks(audit, overlaps)))

    # --- stage 2 ----------------------------------------------------------------------------------------------
    def measure(self) -> None:
        rows = self.store(
            "ticket_metrics", metrics.ticket_metrics(self.tables["normalized_tickets"], self.config.policy)
        )
        self.store("agent_metrics", metrics.agent_metrics(rows.filter("agent_id is not null")))
        self.store("agent_assignment_metrics", metrics.assignment_metrics(rows))
        periods = self.store("period_metrics", metrics.period_metrics(rows))
        self.store("channel_metrics", metrics.summarize(rows, ["channel"]))
        self.store("team_metrics", metrics.summarize(rows, ["agent_team", "agent_tier"]))
        self.store("handle_time_by_source", metrics.handle_time_by_source(rows))
        overall = self.store("overall_metrics", periods.filter("period = 'all'").drop("period_type", "period"))
        failed = metrics.metric_invariants(overall).filter("status = 'FAIL'").collect()
        if failed:
            raise ValueError("metric invariants failed: " + ", ".join(r["name"] for r in failed))

    # --- stage 3 ----------------------------------------------------------------------------------------------
    def compare(self) -> None:
        t = self.tables
        groups = self.store("peer_groups", peers.build_peer_groups(t["normalized_agents"], self.config.peers))
        rows = link.add_product_family(t["ticket_metrics"], t["normalized_products"])
        rows = self.store("enriched_tickets", link.attach_peer_groups(rows, groups))
        mixed = self.store("case_mix_metrics", mix.case_mix_metrics(rows))
        cells = partial(self.store, "peer_cells")
        adjusted = peers.adjusted_agent_metrics(rows, self.config.peers, peer_groups=groups, store=cells)
        adjusted = self.store("adjusted_agent_metrics", adjusted)
        stable = self.store("stability_metrics", stability.assess_adjusted_stability(adjusted))
        compared = self.store("agent_comparison", peers.agent_comparison(adjusted, stable, mixed))
        self.store("case_mix_ranges", mix.case_mix_ranges(mixed))
        self.store("gap_summary", peers.gap_summary(compared))
        self.store("period_outcomes", stability.period_outcomes(rows))

    # --- stage 4 ----------------------------------------------------------------------------------------------
    def price(self) -> None:
        t, policy = self.tables, self.config.policy
        rows = economics.calculate_ticket_economics(t["enriched_tickets"], t["normalized_products"], policy, strict=True)
        rows = self.store("ticket_economics", rows)
        for name, df in economics.economics_rollups(rows).items():
            self.store(name, df)
        totals = self.store("exposure_totals", economics.exposure_totals(rows))
        scenarios = self.store("opportunity_scenarios", economics.opportunity_scenarios(totals))
        validate.assert_checks(
            self.store("economics_checks", validate.economics_invariants(rows, scenarios, economics.SUM_FIELDS))
        )
        linked = products.enrich_tickets(
            products.with_exposure(t["ticket_metrics"], rows), t["normalized_orders"], t["normalized_products"]
        )
        linked = self.store("ticket_order_enriched", linked)
        levels = products.product_levels(linked, policy.minimum_support)
        for name, df in levels.items():
            self.store(f"analysis_{name}", df)
        self.store("one_versus_rest", products.one_versus_rest(linked))
        self.store("match_coverage", products.match_coverage(linked))

    # --- stage 5 ----------------------------------------------------------------------------------------------
    def review(self, predictions: DataFrame | None) -> None:
        """``predictions`` has ticket_id, payload, error and seq; without it every selected ticket is unavailable."""
        t, c = self.tables, self.config
        context = link.review_context(
            t["normalized_tickets"], t["ticket_metrics"], t["ticket_economics"], t["agent_comparison"]
        )
        context = self.store("review_context", context)  # the cut-off and the candidates both start from it
        pool = self.store("review_candidates", textreview.score_candidates(context, limit=c.text_limit))
        chosen = textreview.select_candidates(pool, c.selection_mode, c.selection_size, seed=c.seed)
        chosen = self.store("review_requests", textreview.render_requests(chosen, c.model, c.prompt_version))
        schema = "ticket_id string, payload string, error string, seq int"
        given = self.spark.createDataFrame([], schema) if predictions is None else predictions
        sources = chosen.select("ticket_id", F.array("analysis_customer_text", "analysis_agent_notes").alias("sources"))
        checked = textreview.validate_predictions(given.join(sources, "ticket_id", "left"))
        checked = self.store("validated_predictions", checked)
        outcomes = self.store("review_outcomes", textreview.batch_outcomes(chosen, checked))
        rows = textreview.ticket_rows(chosen, outcomes, c.model, c.prompt_version, predictions is not None)
        rows = self.store("ai_ticket_analysis", rows)
        self.store("ai_agent_diagnostics", textreview.aggregate_diagnostics(rows))
        self.store("ai_peer_diagnostics", textreview.aggregate_diagnostics(rows, "comparison_group"))
        self.store("rejections", textreview.rejection_diagnostics(checked))

    # --- stage 6 ----------------------------------------------------------------------------------------------
    def diagnostics_status(self) -> str:
        """available, partial or unavailable, from the outcomes of stage 5."""
        facts = self.tables["review_outcomes"].agg(
            F.count_if(F.col("analysis_status").isin("analyzed", "cached")).alias("good"),
            F.count_if(F.col("failure").isNotNull()).alias("bad"),
        ).first()
        return "unavailable" if not facts["good"] else "partial" if facts["bad"] else "available"

    def decide(self) -> None:
        t, c = self.tables, self.config
        cited = link.keep_known_references(
            t["ai_agent_diagnostics"], "representative_ticket_ids", t["ai_ticket_analysis"], t["normalized_tickets"], "agent_id"
        )
        inputs = decide.decision_inputs(
            t["agent_comparison"],
            t["adjusted_agent_metrics"],
            t["agent_metrics"],
            economics.agent_exposure(t["ticket_economics"]),
            cited,
        )
        inputs = self.store("decision_inputs", inputs)
        rows = decide.priority_rows(inputs, c.decisions, self.diagnostics_status())
        rows = self.store("training_priority", link.unambiguous_name(rows, t["normalized_agents"]))
        self.store("decision_counts", decide.decision_counts(rows))
        self.store("raw_bottom", decide.raw_bottom(rows))
        self.store("review_lists", decide.review_lists(rows))
        self.store("sla_goal", decide.sla_business_goal(t["overall_metrics"], c.decisions.goal_reduction_points, c.policy.sla_credit))
        self.store("training_budget", decide.training_budget_decision(rows, c.decisions.training_budget))

    # --- stage 7 ----------------------------------------------------------------------------------------------
    def evaluate(self) -> None:
        t, c = self.tables, self.config
        production = robust.production_totals(
            t["overall_metrics"],
            t["exposure_totals"],
            t["ticket_economics"].agg(F.count_if("replacement_issued_flag").alias("replacement_count")),
        )
        reference = robust.independent_reference(t["normalized_tickets"], t["normalized_products"])
        self.store("reconciliation", robust.reconcile(production, reference))
        again = decide.priority_rows(t["decision_inputs"], c.decisions, self.diagnostics_status())
        self.store("stored_decisions", robust.compare_with_stored(again, t["training_priority"]))
        self.store("explanation_checks", robust.explanation_consistency(t["training_priority"]))
        scenarios = self.store("scenario_decisions", robust.decide_scenarios(t["decision_inputs"], config=c.decisions))
        self.store("sensitivity", robust.sensitivity(scenarios))
        self.store("candidate_robustness", robust.candidate_robustness(scenarios))
        minimum = c.decisions.minimum_metric_observations
        resamples = robust.bootstrap_resamples(t["ticket_metrics"], c.bootstrap_replicates, c.seed, minimum)
        resamples = self.store("bootstrap_resamples", resamples)
        self.store("bootstrap_results", robust.bootstrap_summary(resamples, c.bootstrap_replicates))
        candidates = t["training_priority"].filter("priority_status = 'training_candidate'")
        self.store("temporal_results", robust.temporal_leave_one_quarter_out(t["ticket_metrics"], candidates))
        definitions = self.store("peer_robustness", robust.peer_group_robustness(t["ticket_metrics"], candidates))
        self.store("peer_definition_support", robust.peer_definition_support(definitions))


def read_raw(spark: SparkSession, folder: str, multiline: bool = False) -> dict[str, DataFrame]:
    """The five raw CSV tables of a source folder."""
    return {name: readers.load_csv(spark, f"{folder}/{name}.csv", multiline) for name in readers.CONTRACTS}
