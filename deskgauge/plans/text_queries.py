"""Text review queries (over documents, labels and tickets derived from orders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskgauge.functions.text import message_quality, token_estimate
from deskgauge.operators import link, textreview
from deskgauge.plans.adapters import table
from deskgauge.plans.catalog import out, query, staged, with_sql
from deskgauge.plans.money_queries import ORDER_METRICS_SQL, economics_table
from deskgauge.plans.quality_queries import QUALITY_SQL

# --- documents as tickets and predictions about them --------------------------------------------------------------
# These expressions only shape the inputs, in SQL both engines read; what the operators compute is written twice.
EVIDENCE = "regexp_extract(text, '[a-z]{3,}( [a-z]+){0,3}', 0)"
_ISSUE = """CASE n_chars % 5 WHEN 0 THEN 'Connectivity' WHEN 1 THEN 'Billing & Payments' WHEN 2 THEN 'Audio Quality'
  WHEN 3 THEN 'unclear' ELSE 'Other' END"""
_THEME = """CASE n_chars % 4 WHEN 0 THEN 'product_knowledge' WHEN 1 THEN 'communication_clarity' WHEN 2 THEN 'no_recurring_theme'
  ELSE 'troubleshooting' END"""
_STRENGTH = "CASE n_chars % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' ELSE 'low' END"
_CONFIDENCE = "'0.' || CASE WHEN n_chars % 100 < 10 THEN '0' ELSE '' END || CAST(n_chars % 100 AS STRING)"


def _payload(**changes: str) -> str:
    """JSON text of one prediction; values are SQL expressions yielding JSON fragments."""
    quoted = lambda e: f"'\"' || {e} || '\"'"
    fields = {
        "ticket_id": quoted("'D' || CAST(doc_id AS STRING)"),
        "issue_category": quoted(_ISSUE),
        "secondary_category": quoted("'other'"),
        "customer_intent": quoted("'troubleshooting'"),
        "diagnostic_theme": quoted(_THEME),
        "customer_problem": quoted("'problem in ' || lang"),
        "resolution_pattern": quoted("'answered'"),
        "communication_issue": quoted("'unclear'"),
        "policy_process_issue": quoted("'unclear'"),
        "possible_failure_theme": quoted("'none seen'"),
        "evidence": quoted(EVIDENCE),
        "evidence_strength": quoted(_STRENGTH),
        "confidence": _CONFIDENCE,
    }
    fields |= changes
    body = " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields.items() if v)
    return f"'{{' || {body} || '}}'"


_CASES = [
    "'{bad'",
    "'[1, 2]'",
    _payload(confidence=""),
    _payload(surprise="'1'"),
    _payload(ticket_id="'\"D0\"'"),
    _payload(issue_category="'\"Nonsense\"'"),
    _payload(customer_intent="'7'"),
    _payload(diagnostic_theme="'null'"),
    _payload(evidence_strength="'\"High\"'"),
    _payload(confidence="'true'"),
    _payload(confidence="'1.5'"),
    _payload(confidence="'\"0.5\"'"),
    _payload(customer_problem="'12'"),
    _payload(communication_issue="'\"' || repeat('long ', 120) || '\"'"),
    _payload(evidence="'\"Zq never said\"'"),
    _payload(issue_category="'\"insufficient_evidence\"'"),
    _payload(resolution_pattern="'\"this was an Agent Fault\"'"),
]
# a third of the predictions breaks one rule each, the others are well formed
PAYLOAD = (
    f"CASE WHEN n_chars % 3 <> 0 THEN {_payload()} ELSE CASE n_chars % {len(_CASES)} "
    + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_CASES))
    + " END END"
)
_PREDICTIONS_SQL = f"""
preds AS (SELECT 'D' || CAST(doc_id AS STRING) AS ticket_id, source, lang, n_chars, text, {PAYLOAD} AS payload FROM documents),
parsed AS (SELECT *, TRY_CAST(payload AS JSON) AS j FROM preds)"""


def _string_sql(f: str) -> str:
    return f"(CASE WHEN json_type(j, '$.{f}') = 'VARCHAR' THEN json_extract_string(j, '$.{f}') END)"


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_RULE_SQL = (
    "CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'not_an_object' "
    f"WHEN list_sort(json_keys(j)) <> list_sort([{_list(textreview.PAYLOAD_FIELDS)}]) THEN 'fields_mismatch' "
    f"WHEN {_string_sql('ticket_id')} IS DISTINCT FROM ticket_id THEN 'ticket_id_mismatch' "
    + " ".join(
        f"WHEN NOT coalesce({_string_sql(f)} IN ({_list(allowed)}), false) THEN 'invalid_{f}'"
        for f, allowed in textreview.ENUMS.items()
    )
    + " WHEN NOT coalesce(json_type(j, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND "
    "TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) BETWEEN 0 AND 1, false) THEN 'invalid_confidence' "
    + " ".join(
        f"WHEN {_string_sql(f)} IS NULL THEN '{f}_not_string' WHEN length({_string_sql(f)}) > 500 THEN '{f}_too_long'"
        for f in textreview.TEXT_FIELDS
    )
    + f" WHEN {_string_sql('evidence')} <> '' AND (length({_string_sql('evidence')}) > 280 OR NOT contains(text, {_string_sql('evidence')})) "
    "THEN 'evidence_not_quoted' "
    f"WHEN {_string_sql('issue_category')} = 'insufficient_evidence' AND {_string_sql('evidence')} <> '' THEN 'evidence_without_issue' "
    "WHEN regexp_matches(lower(payload), 'agent caused|caused by agent|agent fault|because of the agent') THEN 'causal_claim' END"
)
VALIDATED_SQL = f"{_PREDICTIONS_SQL}, validated AS (SELECT *, {_RULE_SQL} AS rule FROM parsed)"


def predictions(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("ticket_id"),
        "source",
        "lang",
        "n_chars",
        F.expr(PAYLOAD).alias("payload"),
        F.array("text").alias("sources"),
    )


def validated(spark, sf):
    return textreview.validate_predictions(predictions(spark, sf))


def validated_table(spark, sf):
    return staged(spark, sf, "validated_predictions", validated)


@query("txt5_validate_predictions", with_sql(VALIDATED_SQL, "SELECT ticket_id, rule, rule IS NULL AS is_valid FROM validated"))
def _validate(spark, sf):
    return validated(spark, sf).select("ticket_id", "rule", "is_valid")


@query(
    "txt7_rejection_diagnostics",
    with_sql(
        VALIDATED_SQL,
        f"""SELECT ticket_id, rule, CASE WHEN rule = 'not_an_object' THEN '$' WHEN rule = 'fields_mismatch' THEN 'object.fields'
              WHEN rule = 'ticket_id_mismatch' THEN 'ticket_id' WHEN rule LIKE 'evidence\\_%' ESCAPE '\\' THEN 'evidence'
              WHEN rule = 'causal_claim' THEN '$text_fields' WHEN rule LIKE 'invalid%' THEN substr(rule, 9)
              WHEN rule LIKE '%_not_string' THEN substr(rule, 1, length(rule) - 11) ELSE substr(rule, 1, length(rule) - 9) END
              AS validation_field,
            CASE WHEN rule LIKE '%_too_long' THEN length({_string_sql('communication_issue')})
                 WHEN rule LIKE 'evidence%' THEN length({_string_sql('evidence')})
                 WHEN rule = 'ticket_id_mismatch' THEN length({_string_sql('ticket_id')})
                 WHEN rule = 'invalid_issue_category' THEN length({_string_sql('issue_category')})
                 WHEN rule = 'invalid_evidence_strength' THEN length({_string_sql('evidence_strength')}) END AS received_value_length
            FROM validated WHERE rule IS NOT NULL""",
    ),
)
def _diagnostics(spark, sf):
    rows = textreview.rejection_diagnostics(validated_table(spark, sf))
    return rows.select("ticket_id", "rule", "validation_field", "received_value_length")


# every document is requested; answers are missing for one language, failed or came twice for some sources, and some name
# tickets nobody asked for
def _batch(spark, sf):
    v = validated_table(spark, sf)
    answered = v.filter("lang <> 'de'").withColumns(
        {
            "error": F.when(F.col("source") == "src3", "timeout"),
            "seq": F.lit(1),
            "ticket_id": F.when(F.col("source") == "src7", F.concat(F.lit("X"), F.col("ticket_id"))).otherwise(F.col("ticket_id")),
        }
    )
    again = answered.filter("source = 'src5'").withColumn("seq", F.lit(2))
    served = v.filter("source = 'src9' and is_valid").select("ticket_id", *textreview.RESULT_FIELDS)
    return textreview.batch_outcomes(v.select("ticket_id"), answered.unionByName(again), served)


def batch_table(spark, sf):
    return staged(spark, sf, "batch_outcomes", _batch)


BATCH_SQL = (
    VALIDATED_SQL
    + """,
outcomes AS (
  SELECT ticket_id, CASE WHEN source = 'src9' AND rule IS NULL THEN 'cached' WHEN lang = 'de' OR source = 'src7' THEN 'provider_omitted_result'
      WHEN source = 'src3' THEN 'provider_error' WHEN rule IS NOT NULL THEN 'invalid_model_output' ELSE 'analyzed' END
      AS analysis_status, source, lang, rule, n_chars, text, j FROM validated
  UNION ALL SELECT 'X' || ticket_id, 'unknown_ticket_id', source, lang, rule, n_chars, text, j FROM validated
  WHERE source = 'src7' AND lang <> 'de')"""
)


@query(
    "txt6_batch_outcomes",
    with_sql(
        BATCH_SQL,
        """SELECT ticket_id, analysis_status, CASE WHEN analysis_status = 'provider_error' THEN 'provider_error:timeout'
             WHEN analysis_status = 'invalid_model_output' THEN 'invalid_model_output:' || rule END AS failure,
             CASE WHEN source = 'src5' AND lang <> 'de' AND rule IS NULL THEN 1 ELSE 0 END::BIGINT AS duplicate_count FROM outcomes""",
    ),
)
def _outcomes(spark, sf):
    return _batch(spark, sf).select("ticket_id", "analysis_status", "failure", "duplicate_count")


def _reviewed(spark, sf):
    docs = predictions(spark, sf).select(
        "ticket_id",
        F.col("source").alias("agent_id"),
        F.lit("resolved").alias("status"),
        (F.col("n_chars") > 50).alias("attendance_flag"),
        F.col("lang").alias("agent_team"),
        F.lit("T1").alias("agent_tier"),
        F.col("lang").alias("comparison_group"),
        F.lit(True).alias("peer_supported"),
    )
    return textreview.ticket_rows(docs, batch_table(spark, sf), "rules", "v1")


def reviewed_table(spark, sf):
    return staged(spark, sf, "ai_ticket_analysis", _reviewed)


_REVIEWED_SQL = (
    BATCH_SQL
    + f""",
reviewed AS (
  SELECT ticket_id, source AS agent_id, lang AS comparison_group, n_chars > 50 AS attendance_flag,
    CASE WHEN analysis_status IN ('analyzed', 'cached') THEN analysis_status ELSE 'invalid_model_output' END AS analysis_status,
    CASE WHEN analysis_status IN ('analyzed', 'cached') THEN {_string_sql('issue_category')} END AS issue_category,
    CASE WHEN analysis_status IN ('analyzed', 'cached') THEN {_string_sql('diagnostic_theme')} END AS diagnostic_theme,
    CASE WHEN analysis_status IN ('analyzed', 'cached') THEN {_string_sql('evidence_strength')} END AS evidence_strength,
    CASE WHEN analysis_status IN ('analyzed', 'cached') THEN {_string_sql('evidence')} END AS evidence,
    CASE WHEN analysis_status IN ('analyzed', 'cached') THEN CAST(json_extract_string(j, '$.confidence') AS DOUBLE) END AS confidence
  FROM outcomes WHERE analysis_status <> 'unknown_ticket_id')"""
)


@query(
    "txt13_ticket_rows",
    with_sql(
        _REVIEWED_SQL,
        f"SELECT {out('ticket_id agent_id analysis_status issue_category diagnostic_theme evidence_strength', x='confidence')} FROM reviewed",
    ),
)
def _ticket_rows(spark, sf):
    return _reviewed(spark, sf).select(
        "ticket_id", "agent_id", "analysis_status", "issue_category", "diagnostic_theme", "evidence_strength", "confidence"
    )


def _aggregate_sql(key: str) -> str:
    return with_sql(
        _REVIEWED_SQL
        + f""",
used AS (SELECT *, {key} AS k FROM reviewed WHERE analysis_status IN ('analyzed', 'cached') AND attendance_flag),
issue AS (SELECT k, issue_category AS t, count(*) AS n FROM used WHERE issue_category NOT IN ('unclear', 'insufficient_evidence') GROUP BY ALL),
theme AS (SELECT k, diagnostic_theme AS t, count(*) AS n FROM used
  WHERE diagnostic_theme NOT IN ('no_recurring_theme', 'unclear', 'insufficient_evidence') GROUP BY ALL),
cited AS (SELECT k, ticket_id, row_number() OVER (PARTITION BY k ORDER BY coalesce(confidence, 0) DESC, ticket_id) AS r FROM used)""",
        f"""SELECT u.k AS {key}, count(*) AS sample_size,
              CASE WHEN count(*) >= 5 AND count_if(evidence_strength = 'high') >= 3 THEN 'high' WHEN count(*) >= 3 THEN 'moderate'
                   ELSE 'low' END AS evidence_strength,
              (SELECT string_agg(t || '=' || n, '|' ORDER BY n DESC, t) FROM (SELECT *, row_number() OVER (ORDER BY n DESC, t) AS r
                 FROM issue i WHERE i.k = u.k) WHERE r <= 3) AS dominant_issues,
              (SELECT string_agg(t || '=' || n, '|' ORDER BY n DESC, t) FROM theme t2 WHERE t2.k = u.k AND n >= 2) AS recurring,
              (SELECT string_agg(replace(t, '_', ' '), '|' ORDER BY t) FROM theme t3 WHERE t3.k = u.k AND n >= 2) AS training_topics,
              (SELECT string_agg(ticket_id, '|' ORDER BY r) FROM cited c WHERE c.k = u.k AND r <= 5) AS representative_ticket_ids
            FROM used u GROUP BY u.k""",
    )


def _aggregated(spark, sf, key):
    rows = textreview.aggregate_diagnostics(reviewed_table(spark, sf), key)
    listed = lambda c: F.nullif(
        F.array_join(F.transform(c, lambda x: F.concat(x["theme"], F.lit("="), x["count"].cast("string"))), "|"), F.lit("")
    )
    return rows.select(
        key,
        "sample_size",
        "evidence_strength",
        listed("dominant_issue_themes").alias("dominant_issues"),
        listed("recurring_patterns").alias("recurring"),
        F.nullif(F.array_join("training_topics", "|"), F.lit("")).alias("training_topics"),
        "representative_ticket_ids",
    )


@query("txt9_agent_diagnostics", _aggregate_sql("agent_id"))
def _agents(spark, sf):
    return _aggregated(spark, sf, "agent_id")


@query("txt10_peer_diagnostics", _aggregate_sql("comparison_group"))
def _peers(spark, sf):
    return _aggregated(spark, sf, "comparison_group")


def flagged(spark, sf):
    docs = predictions(spark, sf).select("ticket_id", "sources")
    rows = reviewed_table(spark, sf).filter("analysis_status = 'analyzed'").join(docs, "ticket_id")
    return textreview.error_flags(rows)


_FLAGS_SQL = (
    _REVIEWED_SQL
    + """,
flags AS (SELECT ticket_id, false AS unsupported_claim, false AS unsupported_evidence, evidence = '' AS missing_evidence,
  confidence > 0.9 AND evidence_strength = 'low' AS overstated_confidence FROM reviewed WHERE analysis_status = 'analyzed')"""
)


@query("txt8_error_flags", with_sql(_FLAGS_SQL, "SELECT * FROM flags"))
def _flags(spark, sf):
    return flagged(spark, sf).select(
        "ticket_id", "unsupported_claim", "unsupported_evidence", "missing_evidence", "overstated_confidence"
    )


@query(
    "txt11_run_rates",
    with_sql(
        _FLAGS_SQL,
        """SELECT count(*) AS attempted, round(count_if(analysis_status = 'invalid_model_output') / count(*), 6) AS invalid_output_rate,
             (SELECT round(avg(missing_evidence::INT), 6) FROM flags) AS missing_evidence_rate,
             round(count_if(analysis_status = 'invalid_model_output' AND rule = 'causal_claim') / count(*), 6) AS unsupported_claim_rate,
             (SELECT count_if(overstated_confidence) FROM flags) AS overstated_confidence_count
           FROM outcomes WHERE analysis_status NOT IN ('cached', 'unknown_ticket_id')""",
    ),
)
def _rates(spark, sf):
    return textreview.run_rates(batch_table(spark, sf), flagged(spark, sf))


@query(
    "txt11_failure_histogram",
    with_sql(
        BATCH_SQL,
        "SELECT analysis_status AS category, count(*) AS count FROM outcomes GROUP BY analysis_status",
    ),
)
def _histogram(spark, sf):
    return textreview.failure_histogram(batch_table(spark, sf))


# --- eligible text, selection, requests ---------------------------------------------------------------------------
def document_tickets(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("ticket_id"),
        F.col("text").alias("customer_message"),
        F.when(F.col("lang") == "en", F.concat(F.lit("from "), F.col("source"))).alias("agent_notes"),
        message_quality(F.col("text"))["flag"].alias("text_quality_flag"),
    )


@query(
    "txt1_eligible_text",
    with_sql(
        QUALITY_SQL,
        """SELECT 'D' || q.doc_id AS ticket_id, CASE WHEN reason = '' THEN 'usable' ELSE 'degraded' END AS text_quality_state,
             md5(CASE WHEN reason = '' THEN t ELSE '' END) AS customer_text,
             CASE WHEN lang = 'en' THEN 'from ' || source ELSE '' END AS analysis_agent_notes
           FROM doc_quality q JOIN doc_text USING (doc_id) JOIN documents d ON d.doc_id = q.doc_id""",
    ),
)
def _eligible(spark, sf):
    rows = textreview.eligible_text(document_tickets(spark, sf))
    return rows.select(
        "ticket_id", "text_quality_state", F.md5("analysis_customer_text").alias("customer_text"), "analysis_agent_notes"
    )


SCORED_SQL = (
    ORDER_METRICS_SQL
    + """,
scored_c AS (
  SELECT e.*, list_sort(list_filter([CASE WHEN valid_for_csat AND csat_score_numeric <= 2 THEN 'low_csat' END,
      CASE WHEN handle_time_minutes >= (SELECT quantile_cont(handle_time_minutes, 0.9) FROM econ) THEN 'high_handle_time' END,
      CASE WHEN sla_breach_flag THEN 'sla_breach' END, CASE WHEN repeat_contact_candidate_flag THEN 'repeat_contact' END,
      CASE WHEN refund_amount_inr > 0 OR replacement_issued_flag THEN 'refund_or_replacement' END,
      CASE WHEN transfers_numeric >= 2 THEN 'multiple_transfers' END], lambda s: s IS NOT NULL)) AS signals FROM econ e),
candidates AS (SELECT *, len(signals) AS candidate_score FROM scored_c WHERE len(signals) > 0)"""
)


def scored(spark, sf):
    return textreview.score_candidates(economics_table(spark, sf))


@query(
    "txt2_score_candidates",
    with_sql(SCORED_SQL, "SELECT ticket_id, array_to_string(signals, '|') AS selection_signals, candidate_score FROM candidates"),
)
def _score(spark, sf):
    return scored(spark, sf).select("ticket_id", "selection_signals", "candidate_score")


@query(
    "txt3_select_top_n",
    with_sql(SCORED_SQL, "SELECT ticket_id, candidate_score FROM candidates ORDER BY candidate_score DESC, ticket_id LIMIT 250"),
)
def _top_n(spark, sf):
    return textreview.select_candidates(scored(spark, sf), limit=250).select("ticket_id", "candidate_score")


@query(
    "txt3_select_sampled",
    with_sql(
        SCORED_SQL,
        "SELECT ticket_id, candidate_score FROM candidates ORDER BY ('0x' || substr(md5('1701|' || ticket_id), 1, 15))::BIGINT, ticket_id LIMIT 100",
    ),
)
def _sampled(spark, sf):
    return textreview.select_candidates(scored(spark, sf), "sampled", 100).select("ticket_id", "candidate_score")


@query("txt3_select_all", with_sql(SCORED_SQL, "SELECT ticket_id, candidate_score FROM candidates"))
def _all(spark, sf):
    return textreview.select_candidates(scored(spark, sf), "all").select("ticket_id", "candidate_score")


@query("txt3_select_agent_sample", with_sql(SCORED_SQL, "SELECT ticket_id, candidate_score FROM candidates WHERE agent_id = 'S0' ORDER BY candidate_score DESC, ticket_id LIMIT 40"))
def _agent_sample(spark, sf):
    return textreview.select_candidates(scored(spark, sf), "agent_sample", 40, agent_id="S0").select("ticket_id", "candidate_score")


@query("txt3_select_peer_sample", with_sql(SCORED_SQL, "SELECT ticket_id, candidate_score FROM candidates WHERE channel = 'voice' ORDER BY candidate_score DESC, ticket_id LIMIT 60"))
def _peer_sample(spark, sf):
    """The review list of one peer group; the groups here are the channels."""
    grouped = scored(spark, sf).withColumn("comparison_group", F.col("channel"))
    return textreview.select_candidates(grouped, "peer_sample", 60, peer_group="voice").select("ticket_id", "candidate_score")


def requests(spark, sf):
    return textreview.render_requests(scored(spark, sf), "rules", "v1")


_REQUESTS_SQL = (
    SCORED_SQL
    + """,
requests AS (
  SELECT ticket_id, concat('Ticket ', ticket_id, ' on ', channel, ', priority ', priority, ', category unknown. Score ',
      CASE WHEN valid_for_csat THEN csat_score_numeric::VARCHAR ELSE 'not_eligible' END, ', handle minutes ',
      coalesce(handle_time_minutes::VARCHAR, 'not_eligible'), ', response ', CASE WHEN sla_breach_flag THEN 'breached' ELSE 'met' END,
      ', transfers ', coalesce(transfers_numeric, 0), ', refund ', CASE WHEN refund_amount_inr > 0 THEN 'yes' ELSE 'no' END,
      '. replacement ', CASE WHEN replacement_issued_flag THEN 'yes' ELSE 'no' END,
      '. Gaps to peers: score unavailable, handle unavailable, response unavailable. Customer: ', customer_message, ' Notes: ',
      coalesce(agent_notes, '(no notes)')) AS request FROM candidates)"""
)


@query(
    "txt4_render_requests",
    with_sql(
        _REQUESTS_SQL.replace("'. replacement '", "', replacement '"),
        """SELECT ticket_id, md5(request) AS request_hash, CAST(ceil(length(request) / 4) AS BIGINT) AS request_tokens,
             sha256('v1' || chr(0) || 'rules' || chr(0) || request) AS request_key FROM requests""",
    ),
)
def _requests(spark, sf):
    return requests(spark, sf).select("ticket_id", F.md5("request").alias("request_hash"), "request_tokens", "request_key")


# --- cost ---------------------------------------------------------------------------------------------------------
PRICES = {"input_per_million": 0.3, "output_per_million": 2.5}
_COST_SQL = """
cost AS (SELECT count(*) AS requests, sum(greatest(1, ceil(length(text) / 4)))::BIGINT AS input_tokens, count(*) * 180 AS output_tokens
  FROM documents)"""


def _document_requests(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("ticket_id"), token_estimate(F.col("text")).alias("request_tokens")
    )


@query(
    "txt12_cost_estimate",
    with_sql(
        _COST_SQL,
        """SELECT requests, input_tokens, output_tokens, round((input_tokens * 0.3::DOUBLE + output_tokens * 2.5::DOUBLE) / 1e6, 6)
             AS estimated_cost FROM cost""",
    ),
)
def _cost(spark, sf):
    return textreview.cost_estimate(_document_requests(spark, sf), PRICES)


@query(
    "txt12_usage_cost",
    """SELECT count(*) AS requests, count(l.doc_id) AS reported, sum(CASE WHEN l.doc_id IS NOT NULL THEN d.n_chars ELSE 0 END)::BIGINT
         AS tokens_in, sum(CASE WHEN l.doc_id IS NOT NULL THEN 180 ELSE 0 END)::BIGINT AS tokens_out, CAST(NULL AS DOUBLE) AS usage_cost
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _usage(spark, sf):
    # only labelled documents report their usage, so the cost stays unknown
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    usage = docs.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("ticket_id"),
        F.col("n_chars").alias("tokens_in"),
        F.lit(180).alias("tokens_out"),
    )
    return textreview.usage_cost(_document_requests(spark, sf), usage, PRICES)


@query(
    "txt12_monthly_projection",
    with_sql(
        _COST_SQL
        + """,
r AS (SELECT *, (SELECT count(*) FROM labels) / requests AS rate, 650::DOUBLE * 4.333::DOUBLE AS m FROM cost),
p AS (SELECT m AS monthly_tickets, rate AS candidate_rate, round(m * rate, 2) AS targeted_tickets_per_month,
  floor(m * rate * (input_tokens / requests))::BIGINT AS targeted_input_tokens, floor(m * rate * (output_tokens / requests))::BIGINT
    AS targeted_output_tokens, floor(m * (input_tokens / requests))::BIGINT AS full_input_tokens,
  floor(m * (output_tokens / requests))::BIGINT AS full_output_tokens FROM r)""",
        f"""SELECT {out('', 'targeted_input_tokens targeted_output_tokens full_input_tokens full_output_tokens',
              'monthly_tickets candidate_rate targeted_tickets_per_month')},
            round((targeted_input_tokens * 0.3::DOUBLE + targeted_output_tokens * 2.5::DOUBLE) / 1e6, 6) AS targeted_monthly_cost,
            round((full_input_tokens * 0.3::DOUBLE + full_output_tokens * 2.5::DOUBLE) / 1e6, 6) AS full_monthly_cost FROM p""",
    ),
)
def _projection(spark, sf):
    estimate = textreview.cost_estimate(_document_requests(spark, sf), PRICES)
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return textreview.monthly_projection(docs, estimate, labels, PRICES)


# --- labels -------------------------------------------------------------------------------------------------------
def label_pairs(spark, sf):
    """Reviewed quality against the message-quality rule; a short text gets no prediction."""
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.when(
            F.col("n_chars") > 40, F.when(message_quality(F.col("text"))["flag"] == "usable", "1").otherwise("0")
        ).alias("predicted"),
    )
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return labels.join(docs, "doc_id", "left")


PAIRS_SQL = (
    QUALITY_SQL
    + """,
pairs AS (SELECT l.doc_id, CAST(quality AS VARCHAR) AS label,
    CASE WHEN d.n_chars > 40 THEN CASE WHEN reason = '' THEN '1' ELSE '0' END END AS predicted
  FROM labels l LEFT JOIN documents d USING (doc_id) LEFT JOIN doc_quality q USING (doc_id)),
classes AS (SELECT DISTINCT unnest([label, predicted]) AS class FROM pairs),
per_class AS (
  SELECT class, count_if(label = class AND predicted = class) AS tp, count_if(label <> class AND predicted = class) AS fp,
    count_if(label = class AND predicted <> class) AS fn FROM classes, pairs WHERE class IS NOT NULL AND predicted IS NOT NULL
  GROUP BY class)"""
)


@query(
    "sta10_score_classification",
    with_sql(
        PAIRS_SQL,
        """SELECT count(*) AS sample_size, count(predicted) AS evaluated_count,
             round(count_if(label = predicted) / count(predicted), 6) AS accuracy,
             round(1 - count_if(label = predicted) / count(predicted), 6) AS error_rate,
             (SELECT round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) FROM per_class) AS macro_f1,
             (SELECT round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 6) FROM per_class) AS macro_precision,
             (SELECT round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 6) FROM per_class) AS macro_recall FROM pairs""",
    ),
)
def _classification(spark, sf):
    return textreview.score_classification(label_pairs(spark, sf))


@query(
    "sta11_class_metrics",
    with_sql(
        PAIRS_SQL,
        """SELECT class, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
             round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
             tp + fn AS support FROM per_class WHERE tp + fp + fn > 0""",
    ),
)
def _classes(spark, sf):
    return textreview.class_metrics(label_pairs(spark, sf))


@query(
    "sta11_confusion_matrix",
    with_sql(
        PAIRS_SQL,
        """SELECT label, count_if(predicted = '0') AS predicted_0, count_if(predicted = '1') AS predicted_1 FROM pairs
           WHERE predicted IS NOT NULL GROUP BY label""",
    ),
)
def _matrix(spark, sf):
    return textreview.confusion_matrix(label_pairs(spark, sf), ["0", "1"])


@query(
    "jn15_label_predictions",
    with_sql(
        PAIRS_SQL,
        """SELECT p.doc_id, label, predicted AS predicted_label, CASE WHEN predicted IS NOT NULL THEN 'scored'
             WHEN lang = 'en' THEN 'not_analyzed' ELSE 'not_selected' END AS evaluation_status
           FROM pairs p LEFT JOIN documents d ON p.doc_id = d.doc_id""",
    ),
)
def _label_status(spark, sf):
    pairs = label_pairs(spark, sf).withColumn("ticket_id", F.col("doc_id"))
    labels = pairs.select("ticket_id", "label")
    guesses = pairs.filter("predicted is not null").select("ticket_id", F.col("predicted").alias("predicted_label"))
    chosen = table(spark, sf, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("ticket_id"))
    return link.label_predictions(labels, guesses, chosen).withColumnRenamed("ticket_id", "doc_id")
