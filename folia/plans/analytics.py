"""Queries of analytics over events, orders and customers, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.operators import analytics as a
from folia.streaming.limiter import replay_limiter

DAY, MOMENT = "2024-01-02", "1998-06-01 00:00:00"


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.activity_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("plan"),
    )


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("plan"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("feature") == "purchase", F.col("actor"))
    return _activity(spark, sf_dir).select(F.to_date("ts").alias("day"), F.col("actor").alias("session"), known.alias("user_id"))


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir)
    plans = users.select("plan").distinct().select("plan", F.lit("search").alias("feature"), (F.col("plan") < "F").alias("allowed"))
    own = users.where("user_id % 10 = 0").select("user_id", F.lit("search").alias("feature"), F.lit(True).alias("allowed"))
    return a.feature_access(users, plans, own)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "a_dashboard_day": lambda s, d: a.daily_dashboard(_activity(s, d)),
    "a_dashboard_history": lambda s, d: a.dashboard_history(_activity(s, d)),
    "a_presence_15min": lambda s, d: a.presence(_activity(s, d)),
    "a_presence_dense": lambda s, d: a.dense_presence(_activity(s, d), DAY),
    "a_minute_peak": lambda s, d: a.minute_peaks(_activity(s, d)),
    "a_actor_profile": lambda s, d: a.actor_profiles(_activity(s, d)),
    "a_anomaly_topk_filter": lambda s, d: a.anomalous_actors(_activity(s, d), 5, {"requests": 20, "page_run": 3}).select("actor", "requests", "page_run", "minute_peak", "reasons"),
    "w_page_runs": lambda s, d: a.page_runs(_activity(s, d)),
    "j_latest_order_per_customer": lambda s, d: a.users_with_latest_order(_users(s, d).select("user_id"), _orders(s, d)),
    "j_plan_left_theta": lambda s, d: a.members_per_plan(_orders(s, d).select("plan").distinct(), _orders(s, d), MOMENT),
    "j_semi_active": lambda s, d: a.active_members(_users(s, d), _orders(s, d), MOMENT),
    "j_anti_dup_pending": lambda s, d: a.superseded_orders(_orders(s, d)).select("order_id", "user_id", "plan"),
    "j_identity_stitch": lambda s, d: a.stitched_actors(_sessions(s, d)),
    "a_top_users": lambda s, d: a.top_users(_activity(s, d)),
    "a_quota_running": lambda s, d: a.quota_decisions(_activity(s, d), 100.0),
    "r_login_lock": lambda s, d: a.login_locks(_activity(s, d).where("feature = 'error'"), 3, 24 * 60),
    "r_rate_limit_replay": lambda s, d: replay_limiter(_activity(s, d).select(F.col("actor").alias("key"), "ts"), 2, 3600),
    "x_status_machine": lambda s, d: a.order_states(_orders(s, d), "2001-01-01 00:00:00"),
    "p_access_policy": _access,
}

_A = """WITH activity AS (
  SELECT user_id AS actor, ts, event_type AS feature, CAST(json_extract_string(props, '$.k') AS INT) AS page, value AS amount FROM events
), orders_ AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderstatus AS status, o_totalprice AS amount, o_orderdate AS ts, o_orderpriority AS plan FROM orders
)
"""
_DAYS = """, days AS (
  SELECT CAST(ts + INTERVAL 8 HOURS AS DATE) AS day, count(*) AS requests, count(DISTINCT actor) AS actors, count(*) FILTER (feature = 'view') AS views,
         count(*) FILTER (feature = 'click') AS clicks, count(*) FILTER (feature = 'error') AS errors, count(DISTINCT actor) FILTER (feature = 'purchase') AS buyers,
         CAST(coalesce(sum(CAST(amount AS DECIMAL(18, 2))) FILTER (feature = 'purchase'), 0) AS DOUBLE) AS paid
  FROM activity GROUP BY 1)
"""
_RUNS = """, runs AS (
  SELECT actor, feature, max(n) AS page_run FROM (
    SELECT actor, feature, page - rn AS island, count(*) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY actor, feature ORDER BY page) AS rn FROM (SELECT DISTINCT actor, feature, page FROM activity WHERE page > 0)) GROUP BY ALL) GROUP BY ALL
), peaks AS (
  SELECT actor, max(n) AS minute_peak FROM (SELECT actor, date_trunc('minute', ts) AS m, count(*) AS n FROM activity GROUP BY ALL) GROUP BY actor
), profiles AS (
  SELECT actor, count(*) AS requests, count(*) FILTER (feature = 'view') AS images, count(DISTINCT feature) AS volumes,
         count(DISTINCT CASE WHEN page > 0 THEN feature || ':' || page END) AS pages, min(ts) AS first_seen, max(ts) AS last_seen FROM activity GROUP BY actor)
"""
_VALID = f"o.ts <= TIMESTAMP '{MOMENT}' AND TIMESTAMP '{MOMENT}' < o.ts + INTERVAL 30 DAYS"

ORACLE_SQL: dict[str, str] = {
    "a_dashboard_day": _A + _DAYS + "SELECT * FROM days",
    "a_dashboard_history": _A
    + _DAYS
    + """SELECT s.day, coalesce(requests, 0) AS requests, coalesce(actors, 0) AS actors, coalesce(views, 0) AS views, coalesce(clicks, 0) AS clicks, coalesce(errors, 0) AS errors,
           coalesce(buyers, 0) AS buyers, coalesce(paid, 0) AS paid
         FROM (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM days) s LEFT JOIN days USING (day)""",
    "a_presence_15min": _A + "SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS bucket, count(DISTINCT actor) AS actors, count(DISTINCT actor) FILTER (feature = 'purchase') AS buyers FROM activity GROUP BY 1",
    "a_presence_dense": _A
    + f"""SELECT bucket, count(DISTINCT actor) AS actors, count(DISTINCT actor) FILTER (feature = 'purchase') AS buyers
          FROM (SELECT unnest(generate_series(TIMESTAMP '{DAY}', TIMESTAMP '{DAY}' + INTERVAL 1425 MINUTES, INTERVAL 15 MINUTES)) AS bucket) LEFT JOIN activity ON time_bucket(INTERVAL 15 MINUTES, ts) = bucket GROUP BY bucket""",
    "a_minute_peak": _A + _RUNS + "SELECT actor, minute_peak FROM peaks",
    "a_actor_profile": _A + _RUNS + "SELECT * FROM profiles",
    "a_anomaly_topk_filter": _A
    + _RUNS
    + """SELECT actor, requests, page_run, minute_peak, reasons FROM (
           SELECT p.*, coalesce(r.page_run, 0) AS page_run, minute_peak,
                  concat_ws(',', CASE WHEN requests >= 20 THEN 'requests' END, CASE WHEN images >= 200 THEN 'images' END, CASE WHEN minute_peak >= 90 THEN 'minute_peak' END,
                            CASE WHEN pages >= 120 THEN 'pages' END, CASE WHEN volumes >= 8 THEN 'volumes' END, CASE WHEN r.page_run >= 3 THEN 'page_run' END) AS reasons
           FROM (SELECT * FROM profiles ORDER BY requests DESC, images DESC, actor LIMIT 20) p LEFT JOIN peaks USING (actor)
           LEFT JOIN (SELECT actor, max(page_run) AS page_run FROM runs GROUP BY actor) r USING (actor)) WHERE reasons <> '' ORDER BY requests DESC, images DESC, actor LIMIT 5""",
    "w_page_runs": _A + _RUNS + "SELECT actor, feature, page_run FROM runs",
    "j_latest_order_per_customer": _A
    + """SELECT c_custkey AS user_id, order_id, status FROM customer LEFT JOIN
         (SELECT * FROM orders_ QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, order_id DESC) = 1) o ON c_custkey = o.user_id""",
    "j_plan_left_theta": _A + f"SELECT p.plan, count(DISTINCT o.user_id) AS members FROM (SELECT DISTINCT plan FROM orders_) p LEFT JOIN orders_ o ON p.plan = o.plan AND {_VALID} GROUP BY p.plan",
    "j_semi_active": _A + f"SELECT c_custkey AS user_id, c_mktsegment AS plan FROM customer WHERE EXISTS (SELECT 1 FROM orders_ o WHERE o.user_id = c_custkey AND {_VALID})",
    "j_anti_dup_pending": _A + "SELECT order_id, user_id, plan FROM orders_ WHERE status = 'O' AND order_id NOT IN (SELECT max(order_id) FROM orders_ WHERE status = 'O' GROUP BY user_id, plan)",
    "j_identity_stitch": _A
    + """SELECT day, count(DISTINCT coalesce('u:' || u, 's:' || session)) AS actors FROM (
           SELECT CAST(ts AS DATE) AS day, actor AS session, max(CASE WHEN feature = 'purchase' THEN actor END) OVER (PARTITION BY CAST(ts AS DATE), actor) AS u FROM activity) GROUP BY day""",
    "a_top_users": _A + "SELECT actor, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS total, count(*) AS requests FROM activity GROUP BY actor ORDER BY total DESC, requests DESC, actor LIMIT 20",
    "a_quota_running": _A
    + """SELECT actor, ts, CAST(used AS DOUBLE) AS used, used < 100 AS accepted FROM (
           SELECT actor, ts, coalesce(sum(CAST(amount AS DECIMAL(18, 2))) OVER (PARTITION BY actor, CAST(ts AS DATE) ORDER BY ts, page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM activity)""",
    "r_login_lock": _A + "SELECT actor, ts, since FROM (SELECT actor, ts, lag(ts, 2) OVER (PARTITION BY actor ORDER BY ts) AS since FROM activity WHERE feature = 'error') WHERE since >= ts - INTERVAL 1440 MINUTES",
    "x_status_machine": _A
    + """SELECT order_id, user_id, CASE WHEN status = 'O' AND ts < TIMESTAMP '2001-01-01' - INTERVAL 365 DAYS THEN 'expired' WHEN status = 'O' THEN 'pending' WHEN status = 'F' THEN 'paid' ELSE 'processing' END AS state FROM orders_""",
    "p_access_policy": "SELECT c_custkey AS user_id, 'search' AS feature, CASE WHEN c_custkey % 10 = 0 THEN true ELSE c_mktsegment < 'F' END AS allowed FROM customer",
}
