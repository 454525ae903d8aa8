"""Ticket-shaped views over the benchmark tables, and the same views as SQL text for the checks.

Three facts are derived: tickets from ``events`` (unique id, free-form fields), work items from ``lineitem`` (the largest
table, outcome columns ready for peer adjustment) and tickets from ``orders`` (money, products, order links).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskgauge.operators.link import assign_roster


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digits(c) -> F.Column:
    return c.cast("string")


# --- tickets from events ------------------------------------------------------------------------------------------
def event_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumns(
        {
            "k": F.get_json_object("props", "$.k").try_cast("int"),
            "v": F.floor("value").cast("int"),
            "us": F.unix_micros(F.col("ts").cast("timestamp")),
            "step": F.round(F.col("value") * 60000000.0).cast("bigint"),
        }
    )
    c = F.col
    return e.select(
        F.concat(F.lit("E"), _digits(c("event_id"))).alias("ticket_id"),
        F.timestamp_micros("us").alias("created_at"),
        F.when(c("k") % 13 != 0, F.timestamp_micros(c("us") + c("step"))).alias("first_response_at"),
        F.when(c("k") % 11 == 0, F.timestamp_micros(c("us") - c("step") * 400))
        .when(~c("event_type").isin("signup", "error"), F.timestamp_micros(c("us") + c("step") * 3))
        .alias("resolved_at"),
        F.when(c("event_type") == "view", "resolved")
        .when(c("event_type") == "click", "closed")
        .when(c("event_type") == "purchase", " Resolved ")
        .when(c("event_type") == "signup", "open")
        .otherwise("waiting")
        .alias("status"),
        F.element_at(F.array(*[F.lit(x) for x in ("chat", "Email", "voice", "social", "fax")]), c("k") % 5 + 1).alias(
            "channel"
        ),
        F.concat(F.lit("U"), _digits(c("user_id"))).alias("customer_id"),
        F.when(c("k") % 2 == 0, "").otherwise(F.concat(F.lit("O"), _digits(c("k") % 10))).alias("order_id"),
        F.when(c("k") % 17 == 0, "").otherwise(F.concat(F.lit("SKU-"), _digits(c("k") % 10))).alias("product_sku"),
        c("event_type").alias("category"),
        F.element_at(F.array(F.lit("High"), F.lit("Normal"), F.lit("Low")), (c("user_id") % 3).cast("int") + 1).alias(
            "priority"
        ),
        F.concat(F.lit("A"), _digits(c("event_id") % 40)).alias("agent_id"),
        F.concat(F.lit("team"), _digits(c("event_id") % 4)).alias("agent_team"),
        F.concat(F.lit("T"), _digits(c("event_id") % 2 + 1)).alias("agent_tier"),
        F.when(c("v") % 6 == 4, "-1").when(c("v") % 6 == 5, "").otherwise(_digits(c("v") % 6)).alias("transfers"),
        F.when(c("v") % 8 == 0, "")
        .when(c("v") % 8 == 6, "x")
        .when(c("v") % 8 == 7, "9")
        .otherwise(_digits(c("v") % 8))
        .alias("csat_score"),
        F.when(c("event_type") == "purchase", F.round(c("value") * 10, 2)).alias("refund_amount_inr"),
        F.when(c("k") % 10 < 3, "Y").when(c("k") % 10 == 3, "").otherwise("N").alias("replacement_issued"),
        F.when(c("k") % 3 == 0, "").otherwise(F.concat_ws(" ", "event_type", "props")).alias("customer_message"),
        F.when(c("k") % 4 == 0, "").otherwise(F.concat(F.lit("handled "), c("event_type"))).alias("agent_notes"),
        F.when(c("user_id") % 4 == 0, "legacy_fd").otherwise("helpdesk").alias("source_system"),
    )


EVENT_TICKETS_SQL = """
event_raw AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(floor(value) AS INTEGER) AS v,
         epoch_us(ts) AS us, CAST(round(value * 60000000.0) AS BIGINT) AS step
  FROM events),
event_tickets AS (
  SELECT 'E' || event_id AS ticket_id, make_timestamp(us) AS created_at,
    CASE WHEN k % 13 <> 0 THEN make_timestamp(us + step) END AS first_response_at,
    CASE WHEN k % 11 = 0 THEN make_timestamp(us - step * 400)
         WHEN event_type NOT IN ('signup', 'error') THEN make_timestamp(us + step * 3) END AS resolved_at,
    CASE event_type WHEN 'view' THEN 'resolved' WHEN 'click' THEN 'closed' WHEN 'purchase' THEN ' Resolved '
         WHEN 'signup' THEN 'open' ELSE 'waiting' END AS status,
    CASE k % 5 WHEN 0 THEN 'chat' WHEN 1 THEN 'Email' WHEN 2 THEN 'voice' WHEN 3 THEN 'social' ELSE 'fax' END AS channel,
    'U' || user_id AS customer_id,
    CASE WHEN k % 2 = 0 THEN '' ELSE 'O' || (k % 10) END AS order_id,
    CASE WHEN k % 17 = 0 THEN '' ELSE 'SKU-' || (k % 10) END AS product_sku,
    event_type AS category,
    CASE user_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Normal' ELSE 'Low' END AS priority,
    'A' || (event_id % 40) AS agent_id, 'team' || (event_id % 4) AS agent_team, 'T' || (event_id % 2 + 1) AS agent_tier,
    CASE v % 6 WHEN 4 THEN '-1' WHEN 5 THEN '' ELSE CAST(v % 6 AS VARCHAR) END AS transfers,
    CASE v % 8 WHEN 0 THEN '' WHEN 6 THEN 'x' WHEN 7 THEN '9' ELSE CAST(v % 8 AS VARCHAR) END AS csat_score,
    CASE WHEN event_type = 'purchase' THEN round(value * 10, 2) END AS refund_amount_inr,
    CASE WHEN k % 10 < 3 THEN 'Y' WHEN k % 10 = 3 THEN '' ELSE 'N' END AS replacement_issued,
    CASE WHEN k % 3 = 0 THEN '' ELSE event_type || ' ' || props END AS customer_message,
    CASE WHEN k % 4 = 0 THEN '' ELSE 'handled ' || event_type END AS agent_notes,
    CASE WHEN user_id % 4 = 0 THEN 'legacy_fd' ELSE 'helpdesk' END AS source_system
  FROM event_raw)"""


def raw_event_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tickets as a raw extract: times are text, some with an explicit offset, values padded or marked missing."""
    t = event_tickets(spark, sf_dir)
    style = F.when(F.col("priority") == "High", "Z").when(F.col("priority") == "Low", "+02:00").otherwise("")

    def text(name: str):
        return F.coalesce(F.concat(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss"), style), F.lit(""))

    return t.withColumns(
        {
            "created_at": text("created_at"),
            "first_response_at": text("first_response_at"),
            "resolved_at": text("resolved_at"),
            "category": F.concat(F.lit("  "), F.col("category"), F.lit(" \t item")),
            "order_id": F.when(F.col("order_id") == "", "N/A").otherwise(F.col("order_id")),
            "refund_amount_inr": F.coalesce(F.col("refund_amount_inr").cast("string"), F.lit(" none ")),
        }
    )


RAW_EVENT_TICKETS_SQL = (
    EVENT_TICKETS_SQL
    + """,
raw_event_tickets AS (
  SELECT * EXCLUDE (style) REPLACE (
    coalesce(strftime(created_at, '%Y-%m-%dT%H:%M:%S') || style, '') AS created_at,
    coalesce(strftime(first_response_at, '%Y-%m-%dT%H:%M:%S') || style, '') AS first_response_at,
    coalesce(strftime(resolved_at, '%Y-%m-%dT%H:%M:%S') || style, '') AS resolved_at,
    '  ' || category || ' ' || chr(9) || ' item' AS category,
    CASE WHEN order_id = '' THEN 'N/A' ELSE order_id END AS order_id,
    coalesce(CAST(refund_amount_inr AS VARCHAR), ' none ') AS refund_amount_inr)
  FROM (SELECT *, CASE priority WHEN 'High' THEN 'Z' WHEN 'Low' THEN '+02:00' ELSE '' END AS style FROM event_tickets))"""
)

# --- effective-dated roster and work items from lineitem ----------------------------------------------------------
ROSTER_SPANS = (("1995-03-01", "1998-06-30"), ("1998-07-01", None))
LATE_TARGET_DAYS = {"1-URGENT": 200, "2-HIGH": 400, "3-MEDIUM": 600, "4-NOT SPECIFIED": 800, "5-LOW": 1000}


def supplier_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    night = F.when(F.col("s_suppkey") % 3 == 0, "night").otherwise("day")
    spans = F.array(
        *[
            F.struct(
                F.lit(start).cast("date").alias("from_date"),
                F.lit(end).cast("date").alias("to_date"),
                (night if end is None else F.lit("day")).alias("shift"),
            )
            for start, end in ROSTER_SPANS
        ]
    )
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.concat(F.lit("S"), _digits(F.col("s_suppkey"))).alias("agent_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("N"), _digits(F.col("s_nationkey"))).alias("site"),
        F.concat(F.lit("R"), _digits(F.col("n_regionkey"))).alias("team"),
        F.concat(F.lit("T"), _digits(F.col("s_suppkey") % 2 + 1)).alias("tier"),
        F.inline(spans),
    )


ROSTER_SQL = """
roster AS (
  SELECT 'S' || s_suppkey AS agent_id, s_name AS name, 'N' || s_nationkey AS site, 'R' || n_regionkey AS team,
         'T' || (s_suppkey % 2 + 1) AS tier, from_date, to_date,
         CASE WHEN to_date IS NULL AND s_suppkey % 3 = 0 THEN 'night' ELSE 'day' END AS shift
  FROM supplier JOIN nation ON s_nationkey = n_nationkey,
       (VALUES (DATE '1995-03-01', DATE '1998-06-30'), (DATE '1998-07-01', CAST(NULL AS DATE))) AS span(from_date, to_date))"""


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as metric-ready work items with their roster assignment."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    c = F.col
    # one day stands for one minute, which keeps sums of squares exact on both sides of the checks
    minutes = F.datediff(c("l_shipdate"), c("o_orderdate")).cast("double")
    target = F.create_map(*[F.lit(x) for k, d in LATE_TARGET_DAYS.items() for x in (k, d)])
    # what depends on the order alone is derived once an order
    orders = orders.withColumns(
        {
            "reporting_month": F.date_format("o_orderdate", "yyyy-MM"),
            "reporting_quarter": F.concat_ws("-Q", F.year("o_orderdate"), F.quarter("o_orderdate")),
            "target": F.element_at(target, c("o_orderpriority")),
        }
    )
    base = (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(part, c("l_partkey") == c("p_partkey"), "left")
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ticket_id"),
            F.concat(F.lit("S"), _digits(c("l_suppkey"))).alias("agent_id"),
            F.concat(F.lit("C"), _digits(c("o_custkey"))).alias("customer_id"),
            c("o_orderdate").cast("timestamp").alias("created_at"),
            c("l_shipdate").cast("timestamp").alias("resolved_at"),
            c("l_returnflag").alias("channel"),
            c("o_orderpriority").alias("priority"),
            c("p_type").alias("category"),
            c("p_brand").alias("product_family"),
            "reporting_month",
            "reporting_quarter",
            (c("o_orderstatus") != "P").alias("attendance_flag"),
            minutes.alias("minutes"),
            (minutes > c("target")).alias("late"),
            (F.lit(1) + (c("l_quantity").cast("int") % 5)).alias("score"),
            (c("l_linestatus") == "F").alias("scored"),
        )
    )
    timed = c("minutes") >= 0
    items = base.select(
        *[n for n in base.columns if n not in ("minutes", "late", "score", "scored")],
        (c("attendance_flag") & c("scored")).alias("valid_for_csat"),
        F.when(c("scored"), c("score")).alias("csat_score_numeric"),
        (c("attendance_flag") & timed).alias("valid_for_handle_time"),
        F.when(c("attendance_flag") & timed, c("minutes")).alias("handle_time_minutes"),
        timed.alias("valid_for_sla"),
        F.when(timed, c("late")).alias("sla_breach_flag"),
    )
    return assign_roster(items, supplier_roster(spark, sf_dir), "created_at").drop("agent_name", "roster_match_count")


WORK_ITEMS_SQL = (
    ROSTER_SQL
    + """,
work_base AS (
  SELECT l_orderkey || '-' || l_linenumber AS ticket_id, 'S' || l_suppkey AS agent_id, 'C' || o_custkey AS customer_id,
    o_orderdate AS created_at, l_shipdate AS resolved_at, l_returnflag AS channel, o_orderpriority AS priority,
    p_type AS category, p_brand AS product_family, strftime(o_orderdate, '%Y-%m') AS reporting_month,
    year(o_orderdate) || '-Q' || quarter(o_orderdate) AS reporting_quarter, o_orderstatus <> 'P' AS attendance_flag,
    date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))::DOUBLE AS minutes,
    1 + CAST(floor(l_quantity) AS INTEGER) % 5 AS score, l_linestatus = 'F' AS scored,
    CASE o_orderpriority WHEN '1-URGENT' THEN 200 WHEN '2-HIGH' THEN 400 WHEN '3-MEDIUM' THEN 600
         WHEN '4-NOT SPECIFIED' THEN 800 ELSE 1000 END AS target
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey),
work_items AS (
  SELECT b.* EXCLUDE (minutes, score, scored, target), attendance_flag AND scored AS valid_for_csat,
    CASE WHEN scored THEN score END AS csat_score_numeric,
    attendance_flag AND minutes >= 0 AS valid_for_handle_time,
    CASE WHEN attendance_flag AND minutes >= 0 THEN minutes END AS handle_time_minutes,
    minutes >= 0 AS valid_for_sla, CASE WHEN minutes >= 0 THEN minutes > target END AS sla_breach_flag,
    r.team AS agent_team, r.tier AS agent_tier, r.site AS agent_site, r.shift AS agent_shift,
    r.from_date AS agent_from_date, r.to_date AS agent_to_date,
    CASE WHEN r.agent_id IS NOT NULL THEN 'matched' ELSE 'no_roster_interval' END AS agent_assignment_flag
  FROM work_base b LEFT JOIN roster r ON b.agent_id = r.agent_id AND CAST(created_at AS DATE) >= r.from_date
    AND (r.to_date IS NULL OR CAST(created_at AS DATE) <= r.to_date))"""
)


# --- tickets, order dimension and products from orders ------------------------------------------------------------
def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the line facts the ticket view needs."""
    c = F.col
    returned = c("l_returnflag") == "R"
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_partkey").alias("partkey"),
            F.min("l_suppkey").alias("suppkey"),
            F.count(F.lit(1)).alias("lines"),
            F.max("l_shipdate").alias("shipped"),
            F.sum(F.when(returned, F.floor(c("l_extendedprice") * c("l_discount") * 100.0).cast("bigint"))).alias(
                "refund_cents"
            ),
            F.max(F.when(returned, 1).otherwise(0)).alias("any_returned"),
            F.sum(c("l_quantity").cast("int")).alias("quantity"),
        )
        .withColumn("refund", (c("refund_cents") * F.lit(Decimal("0.01"))).cast("decimal(18,2)"))
    )


def order_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), F.col
    key = c("o_orderkey")
    placed = F.unix_micros(c("o_orderdate").cast("timestamp"))
    wait = (F.floor(c("o_totalprice")).cast("bigint") % 600) * 60000000
    joined = o.join(order_lines(spark, sf_dir), key == c("l_orderkey"), "left")
    priorities = F.element_at(
        F.create_map(
            *[
                F.lit(x)
                for pair in (
                    ("1-URGENT", "voice"),
                    ("2-HIGH", "chat"),
                    ("3-MEDIUM", "email"),
                    ("4-NOT SPECIFIED", "social"),
                    ("5-LOW", "email"),
                )
                for x in pair
            ]
        ),
        c("o_orderpriority"),
    )
    return joined.select(
        F.concat(F.lit("T"), _digits(key)).alias("ticket_id"),
        F.timestamp_micros(placed).alias("created_at"),
        F.timestamp_micros(placed + wait).alias("first_response_at"),
        c("shipped").cast("timestamp").alias("resolved_at"),
        F.when(c("o_orderstatus") == "F", "resolved")
        .when(c("o_orderstatus") == "O", "closed")
        .otherwise("pending")
        .alias("status"),
        priorities.alias("channel"),
        F.concat(F.lit("C"), _digits(c("o_custkey") + F.when(key % 50 == 1, 1).otherwise(0))).alias("customer_id"),
        F.when(key % 3 != 0, F.concat(F.lit("O"), _digits(key))).alias("order_id"),
        F.concat(F.lit("P"), _digits(c("partkey"))).alias("product_sku"),
        c("o_orderpriority").alias("priority"),
        F.concat(F.lit("S"), _digits(c("suppkey"))).alias("agent_id"),
        F.concat(F.lit("team"), _digits(c("suppkey") % 5)).alias("agent_team"),
        F.concat(F.lit("T"), _digits(c("suppkey") % 2 + 1)).alias("agent_tier"),
        _digits(c("lines") - 1).alias("transfers"),
        F.when(c("quantity") % 3 != 0, _digits(c("quantity") % 5 + 1)).alias("csat_score"),
        c("refund").cast("decimal(18,2)").alias("refund_amount_inr"),
        F.when(c("refund").isNotNull(), F.when(c("quantity") % 2 == 0, "defective").otherwise("late")).alias(
            "refund_reason_code"
        ),
        F.when(c("quantity") % 4 == 0, None).when(c("any_returned") == 1, "Y").otherwise("N").alias(
            "replacement_issued"
        ),
        F.when(key % 10 == 0, "legacy_fd").otherwise("helpdesk").alias("source_system"),
        F.concat_ws(" ", F.lit("Order"), key, F.lit("of"), "o_orderdate").alias("customer_message"),
        F.when(c("quantity") % 2 == 0, F.concat_ws(" ", F.lit("units"), c("quantity"))).alias("agent_notes"),
        F.lit("usable").alias("text_quality_flag"),
    )


def order_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have lines, as the order dimension of the link operators."""
    o, c = table(spark, sf_dir, "orders"), F.col
    return o.join(order_lines(spark, sf_dir), c("o_orderkey") == c("l_orderkey")).select(
        F.concat(F.lit("O"), _digits(c("o_orderkey"))).alias("order_id"),
        F.concat(F.lit("C"), _digits(c("o_custkey"))).alias("customer_id"),
        F.concat(F.lit("P"), _digits(c("partkey"))).alias("sku"),
        F.to_date("o_orderdate").alias("order_date"),
        c("o_orderpriority").alias("channel"),
        c("quantity").cast("int").alias("qty"),
        c("o_totalprice").cast("decimal(18,2)").alias("order_value_inr"),
        F.concat(F.lit("L"), F.date_format("o_orderdate", "yyyy")).alias("lot_code"),
    )


def product_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products; the cost of one in ten is unknown."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), _digits(F.col("p_partkey"))).alias("sku"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("family"),
        F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice").cast("decimal(18,2)")).alias("unit_cost_inr"),
        F.col("p_size").alias("warranty_months"),
        F.make_date(F.lit(1994) + F.col("p_size") % 6, F.lit(1), F.lit(1)).alias("launch_date"),
    )


ORDER_TICKETS_SQL = """
order_lines AS (
  SELECT l_orderkey, min(l_partkey) AS partkey, min(l_suppkey) AS suppkey, count(*) AS lines, max(l_shipdate) AS shipped,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_extendedprice * l_discount * 100.0) AS BIGINT) END) * 0.01
      AS DECIMAL(18,2)) AS refund,
    max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS any_returned,
    sum(CAST(floor(l_quantity) AS INTEGER)) AS quantity
  FROM lineitem GROUP BY l_orderkey),
order_tickets AS (
  SELECT 'T' || o_orderkey AS ticket_id, o_orderdate AS created_at,
    make_timestamp(epoch_us(o_orderdate) + (CAST(floor(o_totalprice) AS BIGINT) % 600) * 60000000) AS first_response_at,
    shipped AS resolved_at,
    CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'closed' ELSE 'pending' END AS status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'voice' WHEN '2-HIGH' THEN 'chat' WHEN '4-NOT SPECIFIED' THEN 'social'
         ELSE 'email' END AS channel,
    'C' || (o_custkey + CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END) AS customer_id,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'O' || o_orderkey END AS order_id, 'P' || partkey AS product_sku,
    o_orderpriority AS priority, 'S' || suppkey AS agent_id, 'team' || (suppkey % 5) AS agent_team,
    'T' || (suppkey % 2 + 1) AS agent_tier, CAST(lines - 1 AS VARCHAR) AS transfers,
    CASE WHEN quantity % 3 <> 0 THEN CAST(quantity % 5 + 1 AS VARCHAR) END AS csat_score,
    CAST(refund AS DECIMAL(18,2)) AS refund_amount_inr,
    CASE WHEN refund IS NOT NULL THEN CASE WHEN quantity % 2 = 0 THEN 'defective' ELSE 'late' END END AS refund_reason_code,
    CASE WHEN quantity % 4 = 0 THEN NULL WHEN any_returned = 1 THEN 'Y' ELSE 'N' END AS replacement_issued,
    CASE WHEN o_orderkey % 10 = 0 THEN 'legacy_fd' ELSE 'helpdesk' END AS source_system,
    'Order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS customer_message,
    CASE WHEN quantity % 2 = 0 THEN 'units ' || quantity END AS agent_notes, 'usable' AS text_quality_flag
  FROM orders LEFT JOIN order_lines ON o_orderkey = l_orderkey),
order_dim AS (
  SELECT 'O' || o_orderkey AS order_id, 'C' || o_custkey AS customer_id, 'P' || partkey AS sku,
    CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS channel, quantity AS qty,
    CAST(o_totalprice AS DECIMAL(18,2)) AS order_value_inr, 'L' || strftime(o_orderdate, '%Y') AS lot_code
  FROM orders JOIN order_lines ON o_orderkey = l_orderkey),
products AS (
  SELECT 'P' || p_partkey AS sku, p_name AS product_name, p_brand AS family,
    CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_retailprice AS DECIMAL(18,2)) END AS unit_cost_inr,
    p_size AS warranty_months, make_date(1994 + p_size % 6, 1, 1) AS launch_date FROM part)"""
