"""Queries of accounts, orders, journals, guards and whole answers, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.operators import accounts as a
from folia.operators import corpus, guard, journal, planner, search
from folia.plans.search import _PAGES, _SECTIONS, _contents, _matches, _pages, _with
from folia.plans.shared import rows, with_inputs

NOW = "TIMESTAMP '1998-07-01 00:00:00'"


def _now() -> Column:
    return F.lit("1998-07-01 00:00:00").cast("timestamp_ntz")


ORDERS = """
SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderpriority AS plan, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'paid' ELSE 'failed' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN 100.0 ELSE 200.0 END AS amount, CASE WHEN o_orderkey % 4 = 0 THEN 'old' ELSE '' END AS notes, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '1998-08-01 00:00:00' END AS expires_at FROM {orders}"""
PLANS = "SELECT o_orderpriority AS plan, 100.0 AS price, o_orderpriority <> '5-LOW' AS is_active FROM {orders} GROUP BY o_orderpriority"
USERS = """
SELECT c_custkey AS user_id, c_name AS name, c_mktsegment AS plan, c_custkey % 7 <> 0 AS is_active, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'x' END AS verified_at,
  CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-01-02 03:00:00' ELSE TIMESTAMP '2023-01-01 00:00:00' END AS created_at FROM {customer}"""
ASKED = "SELECT c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' ELSE '3-MEDIUM' END AS plan FROM {customer}"
PAYMENTS = "SELECT l_orderkey AS order_id, l_linenumber AS event_id, l_shipdate AS paid_at FROM {lineitem}"
PAID = "SELECT o_custkey AS user_id, o_orderkey AS order_id, o_orderdate AS paid_at, CASE WHEN o_orderkey % 5 = 0 THEN 12 ELSE 1 END AS months FROM {orders}"
TRADES = """
SELECT order_id, status, amount, TIMESTAMP '2024-01-02 01:00:00' AS created_at, CASE WHEN status = 'paid' AND order_id % 2 = 0 THEN TIMESTAMP '2024-01-02 10:00:00' END AS paid_at FROM (""" + ORDERS + ") AS o"
ACTIVITY = """
SELECT ts, user_id AS session, CASE WHEN event_type = 'purchase' THEN user_id END AS user_id, event_id % 9 <> 0 AS success, value AS amount, CASE WHEN event_id % 2 = 0 THEN 'sub' ELSE 'main' END AS provider,
  CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'reader' WHEN 'error' THEN 'ai' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'pricing' ELSE 'pricing_journal' END ELSE 'site' END AS feature FROM {events}"""
MEMBERS = "SELECT c_custkey AS user_id, TIMESTAMP '2024-01-01 00:00:00' AS starts, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE TIMESTAMP '2024-01-02 00:00:00' END AS ends FROM {customer}"
TOKENS = """
SELECT c_custkey AS token_id, 'u' || CAST(c_custkey % 500 AS STRING) || '@x.org' AS email, 'login' AS purpose, CASE WHEN c_custkey % 2 = 0 THEN 'c1' ELSE 'c2' END AS code, c_custkey % 11 = 0 AS used,
  c_custkey % 6 AS attempts, TIMESTAMP '1998-06-01 00:00:00' AS created_at, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '1998-06-30 00:00:00' ELSE TIMESTAMP '1998-07-02 00:00:00' END AS expires_at FROM {customer}"""
TRIES = "SELECT o_orderkey AS attempt_id, ' U' || CAST(o_custkey % 500 AS STRING) || '@x.org' AS email, 'login' AS purpose, CASE WHEN o_orderkey % 3 = 0 THEN 'c1' ELSE 'c9' END AS code, o_orderdate AS tried_at FROM {orders}"
DEVICES = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'revoked' ELSE 'active' END AS status, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '1999-01-01 00:00:00' ELSE 'soon' END AS expires_at FROM {supplier}"
CHANNELS = "SELECT DISTINCT p_type AS channel FROM {part}"
RELEASES = "SELECT p_partkey AS release_id, p_type AS channel, p_brand AS app_version, p_partkey % 3 = 0 AND p_type <> 'PROMO' AS is_active, p_size AS created_at FROM {part}"
MESSAGES = "SELECT conv_id AS thread_id, turn AS message_id, CASE role WHEN 'user' THEN 'user' ELSE 'admin' END AS role, turn * 10 AS created_at FROM {conversations}"
SETTINGS = "SELECT c_mktsegment AS scope, c_nationkey AS name, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS STRING) END AS value, c_custkey AS seen FROM {customer} WHERE c_custkey % 2 = 0"
CHANGES = "SELECT c_mktsegment AS scope, c_nationkey AS name, CASE WHEN c_custkey % 3 <> 0 THEN 'n' || CAST(c_custkey AS STRING) END AS value, c_custkey AS seen FROM {customer} WHERE c_custkey % 2 = 1 AND c_nationkey < 20"
COUNTERS = "SELECT user_id, event_type AS feature, count(*) AS n, max(ts) AS seen FROM {events} WHERE event_id < 5000 GROUP BY user_id, event_type"
SEEN = "SELECT user_id, event_type AS feature, ts AS seen FROM {events} WHERE event_id >= 5000"

WORKS = """
SELECT o_orderkey AS article_id, o_custkey % 25 AS source, CASE WHEN o_orderkey % 6 = 0 THEN 'Masthead' ELSE 'Title of ' || o_orderpriority END AS title,
  CASE o_orderkey % 4 WHEN 0 THEN substr(CAST(o_orderdate AS STRING), 1, 10) WHEN 1 THEN substr(CAST(o_orderdate AS STRING), 1, 7) WHEN 2 THEN substr(CAST(o_orderdate AS STRING), 1, 4) ELSE '' END AS published_at FROM {orders}"""
SOURCES = """
SELECT n_nationkey AS source, CASE n_nationkey % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'web_html' WHEN 2 THEN 'openalex' WHEN 3 THEN 'manual' ELSE 'Web_HTML' END AS source_type, n_nationkey % 6 <> 0 AS is_enabled, n_nationkey % 2 = 0 AS auto_publish,
  CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE '1234-5678' END AS issn, CASE n_nationkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'http://old.example/list' ELSE 'http://a.example' END AS source_url, CASE WHEN n_nationkey % 2 = 0 THEN 'e' END AS entry_url,
  CASE WHEN n_nationkey % 3 <> 1 THEN 'p' END AS parser, CASE WHEN n_regionkey < 2 THEN 'en' ELSE 'zh' END AS language, CASE WHEN n_nationkey % 2 = 0 THEN '{}' ELSE 'code=7' END AS config FROM {nation}"""
DEFAULTS = """
SELECT n_nationkey + 5 AS source, CASE WHEN n_nationkey % 2 = 0 THEN 'manual' ELSE 'rss' END AS source_type, 'new' AS issn, 'http://new.example' AS source_url, 'code=9' AS config, CASE WHEN n_nationkey % 3 = 0 THEN 'code=7' ELSE '' END AS code FROM {nation}"""
ARTICLES = """
SELECT o_orderkey AS article_id, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'own abstract' END AS abstract, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'A;B;C;D' END AS authors, CASE o_orderkey % 3 WHEN 0 THEN '1998-01-01' WHEN 1 THEN '1999' ELSE '2000-05-06' END AS published_at,
  '' AS pages, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '10.1/x' END AS doi, CASE WHEN o_orderkey % 7 = 0 THEN '4' ELSE '' END AS issue, o_orderpriority AS title, 'Journal' AS journal, CASE WHEN o_orderkey % 2 = 0 THEN '12' ELSE '' END AS volume,
  CASE WHEN o_orderkey % 2 = 0 THEN 'zh-CN' ELSE 'en' END AS language, CASE WHEN o_orderkey % 2 = 0 THEN 'n1' END AS source_id FROM {orders}"""
DETAILS = "SELECT o_orderkey AS article_id, 'new abstract' AS abstract, 'X;Y' AS authors, '1998-03-04' AS published_at, '1-9' AS pages, '10.2/y' AS doi, '8' AS issue FROM {orders} WHERE o_orderkey % 4 <> 0"
BATCHES = "SELECT n_nationkey AS batch_id, CASE n_nationkey % 5 WHEN 0 THEN 'collecting' WHEN 1 THEN 'reviewing' WHEN 2 THEN 'ready_to_send' WHEN 3 THEN 'sent' ELSE 'archived' END AS status, n_regionkey AS created_at FROM {nation}"
BATCHED = "SELECT o_orderkey AS article_id, CASE WHEN o_custkey % 30 < 25 THEN o_custkey % 30 END AS batch_id, CASE o_orderkey % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'pending_review' WHEN 2 THEN 'ignored' ELSE 'translation_pending' END AS status FROM {orders}"
REVIEW = "SELECT o_orderkey AS article_id, o_orderpriority AS discipline, o_orderkey AS n FROM {orders}"
ADDRESSES = "SELECT CASE WHEN c_custkey % 9 = 0 THEN '' ELSE ' M' || CAST(c_custkey % 800 AS STRING) || '@X.org' END AS email FROM {customer}"
DELIVERED = "SELECT 'm' || CAST(s_suppkey AS STRING) || '@x.ORG ' AS email FROM {supplier}"
PAIRS = "SELECT o_custkey AS subscription_id, o_orderkey AS article_id FROM {orders}"
SUBSCRIBERS = "SELECT c_custkey AS subscription_id, CASE WHEN c_custkey % 8 = 0 THEN ' ' ELSE 'a@b.c' END AS email FROM {customer}"
VISITORS = """
SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'user' ELSE 'ip' END AS actor_type, CASE WHEN user_id % 4 = 0 THEN '10.0.0.' || CAST(user_id % 200 AS STRING) ELSE '8.8.4.' || CAST(user_id % 200 AS STRING) END AS ip, count(*) AS requests, max(event_id) % 7 AS minute_peak
FROM {events} GROUP BY user_id"""
GIVEN = """SELECT doc_id AS query_id, '{"quotes": ["' || substr(lang, 1, 1) || '", "ab", " cd "], "fragments": null, "keywords": ["k' || CAST(doc_id AS STRING) || '"]}' AS plan FROM {documents} WHERE lang IS NOT NULL"""
CANDIDATES = "SELECT o_custkey AS query_id, l_linenumber AS index, l_partkey AS item FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
RANKING = "SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS place, CASE WHEN l_partkey % 9 = 0 THEN 'x' ELSE CAST(l_linenumber AS STRING) END AS index, CASE WHEN l_partkey % 5 = 0 THEN 'high' ELSE CAST(CAST(l_quantity * 4 AS INT) AS STRING) END AS confidence, '  because  of ' || l_returnflag AS reason FROM {lineitem}"

SEGMENTS = ["3-MEDIUM", "1-URGENT"]


def o_verify_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = rows(spark, sf_dir, TOKENS).withColumn("code_hash", F.sha2("code", 256))
    return a.verify_codes(tokens, rows(spark, sf_dir, TRIES), _now())


def o_dashboard_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.dashboard(*(rows(spark, sf_dir, x) for x in (USERS, TRADES, MEMBERS, ACTIVITY)), "2024-01-02")


def j_collect_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.collect(rows(spark, sf_dir, WORKS), rows(spark, sf_dir, SOURCES), F.lit("1997-03-15").cast("date")).select("article_id", "source", "status")


def j_merge_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda x: rows(spark, sf_dir, x).withColumn("authors", F.filter(F.split("authors", ";"), lambda w: w != ""))
    return journal.merge_details(listed(ARTICLES), listed(DETAILS)).select("article_id", "abstract", "published_at", "pages", "doi", "issue", "citation")


def j_archive_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches, articles = journal.archive_batches(rows(spark, sf_dir, BATCHES), rows(spark, sf_dir, BATCHED))
    return articles.groupBy("status").agg(F.count("*").alias("n")).unionByName(batches.groupBy(F.concat(F.lit("batch "), "status").alias("status")).agg(F.count("*").alias("n")))


def j_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("daily", "weekly", "biweekly", "monthly")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    now, weekday, last = F.col("o_orderdate").cast("timestamp"), (F.col("o_custkey") % 7).cast("int"), F.expr("cast(date_sub(o_orderdate, cast(o_custkey % 40 AS INT)) AS timestamp)")
    last = F.when(F.col("o_custkey") % 11 != 0, last)
    return orders.select("o_orderkey", journal.send_due(kind, weekday, now).alias("send"), journal.collect_due(kind, weekday, now, last, F.col("o_custkey") % 13 == 0).alias("collect"))


def j_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = rows(spark, sf_dir, ARTICLES)
    zh = F.when(F.col("article_id") % 4 == 0, F.lit("译名"))
    b = journal.brief(F.filter(F.split("authors", ";"), lambda w: w != ""), zh, F.col("title"), F.col("abstract"))
    return held.select("article_id", b["title"].alias("title"), b["authors"].alias("authors"), b["abstract"].alias("abstract"), journal.translation_status(F.col("language"), zh, F.col("abstract"), F.lit("")).alias("status"))


def t_grouped_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    sections = corpus.with_sections(pages.select("source_file", "pdf_page", "printed_page"), _contents(spark, sf_dir))
    form, _, groups = planner.grouped_search(pages, sections, corpus.book_dimension(spark), "tion the", book="en")
    return groups.drop("front").withColumn("form", F.lit(form))


def t_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planner.parsed_plan(F.col("plan"))
    return rows(spark, sf_dir, GIVEN).select("query_id", F.array_join(p["quotes"], "|").alias("quotes"), F.size(p["fragments"]).alias("fragments"), F.array_join(p["keywords"], "|").alias("keywords"))


def t_two_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    first = search.match_spans(pages, "nowhere to be found").select("source_file", F.col("first_page").alias("pdf_page"))
    return planner.two_tier(first, pages, "tion, thereof; onand edble").select("source_file", "pdf_page")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "o_orders_with_plans": lambda s, d: a.orders_with_plans(rows(s, d, ORDERS), rows(s, d, PLANS), rows(s, d, USERS)).select("order_id", "user_id", "name", "price"),
    "o_payment_trail": lambda s, d: a.payment_trail(rows(s, d, PAYMENTS), rows(s, d, ORDERS).where("status <> 'failed'"), rows(s, d, USERS)).select("order_id", "event_id", "status", "name"),
    "o_expire_orders": lambda s, d: a.expire_orders(rows(s, d, ORDERS), _now()).select("order_id", "status"),
    "o_request_orders": lambda s, d: a.request_orders(rows(s, d, ORDERS), rows(s, d, ASKED), rows(s, d, PLANS), _now()),
    "o_mark_paid": lambda s, d: a.mark_paid(rows(s, d, ORDERS), rows(s, d, PAYMENTS)).select("order_id", "status", "paid_by"),
    "o_stacked_memberships": lambda s, d: a.stacked_memberships(rows(s, d, PAID).withColumn("paid_at", F.col("paid_at").cast("timestamp"))).select("order_id", F.unix_seconds("starts").alias("starts"), F.unix_seconds("ends").alias("ends")),
    "o_active_plans": lambda s, d: a.active_plans(rows(s, d, USERS), rows(s, d, MEMBERS).select("user_id", *[F.col(c).cast("timestamp").alias(c) for c in ("starts", "ends")]), F.lit("2024-01-20 12:00:00").cast("timestamp")),
    "o_dashboard_scalars": o_dashboard_scalars,
    "o_verify_codes": o_verify_codes,
    "o_devices": lambda s, d: rows(s, d, DEVICES).select("id", a.is_authorized(F.col("status"), F.col("expires_at"), F.lit("1998-07-01").cast("timestamp")).alias("authorized")),
    "o_releases": lambda s, d: a.current_releases(rows(s, d, CHANNELS), rows(s, d, RELEASES), "0.1"),
    "o_threads": lambda s, d: a.threads(rows(s, d, MESSAGES)),
    "o_put": lambda s, d: a.put(a.latest(rows(s, d, SETTINGS), ["scope", "name"], [F.desc("seen")]), rows(s, d, CHANGES), ["scope", "name"], "seen"),
    "o_put_absent": lambda s, d: a.put_absent(a.latest(rows(s, d, CHANGES), ["scope", "name"], [F.desc("seen")]), a.latest(rows(s, d, SETTINGS), ["scope", "name"], [F.desc("seen")]), ["scope", "name"]),
    "o_count_up": lambda s, d: a.count_up(rows(s, d, COUNTERS), rows(s, d, SEEN), ["user_id", "feature"], "n", "seen"),
    "o_delete_where": lambda s, d: a.delete_where(rows(s, d, ORDERS), (F.col("status") == "failed") | (F.col("expires_at") < F.lit("1999-01-01").cast("timestamp_ntz"))).select("order_id"),
    "o_find_users": lambda s, d: a.find_users(rows(s, d, USERS), " buILd ", 30).select("user_id", "name"),
    "o_page": lambda s, d: a.page(rows(s, d, ORDERS), [F.desc("created_at"), F.desc("order_id")], 50, {"status": "paid", "notes": ""}, {"plan": ["1-URGENT", "2-HIGH"]}).select("order_id", "plan"),
    "a_status_histogram": lambda s, d: a.histogram(rows(s, d, ORDERS), "plan", "status"),
    "a_distinct_sets": lambda s, d: a.distinct_sets(rows(s, d, ACTIVITY), "session", "provider", "feature"),
    "a_first_day": lambda s, d: a.first_day((rows(s, d, ORDERS), "created_at"), (rows(s, d, PAYMENTS), "paid_at"), (rows(s, d, ACTIVITY), "ts")).select(F.col("day").cast("string").alias("day")),
    "j_collect_window": j_collect_window,
    "j_merge_details": j_merge_details,
    "j_archive_batches": j_archive_batches,
    "j_public_batch": lambda s, d: journal.public_batch(rows(s, d, BATCHES)).withColumn("next", journal.next_state(F.col("status"), F.lit(True), F.lit(False))),
    "j_review_list": lambda s, d: journal.review_list(rows(s, d, REVIEW), SEGMENTS, "other").select("article_id", "discipline", "ref"),
    "j_recipients": lambda s, d: journal.recipients("registered", *(rows(s, d, x) for x in (DELIVERED, DELIVERED, ADDRESSES, DELIVERED, DELIVERED))),
    "j_digests": lambda s, d: journal.digests(rows(s, d, PAIRS), rows(s, d, WORKS), rows(s, d, SUBSCRIBERS), 3),
    "j_source_state": lambda s, d: journal.source_state(rows(s, d, SOURCES)).select("source", "complete", "auto_send", "label"),
    "j_completeness": lambda s, d: journal.completeness_by_language(rows(s, d, SOURCES)),
    "j_backfill_sources": lambda s, d: journal.backfill_sources(rows(s, d, SOURCES), rows(s, d, DEFAULTS), "old[.]example"),
    "j_due": j_due,
    "j_briefs": j_briefs,
    "g_to_ban": lambda s, d: guard.to_ban(rows(s, d, VISITORS), rows(s, d, VISITORS).where("user_id % 10 = 1"), rows(s, d, VISITORS).where("user_id % 10 = 2"), 20, 2),
    "g_online": lambda s, d: guard.online(rows(s, d, ACTIVITY).withColumnRenamed("session", "actor"), F.lit("2024-01-02 06:00:00").cast("timestamp_ntz"), 60),
    "g_retained": lambda s, d: guard.retained(rows(s, d, ACTIVITY), "ts", F.lit("2024-01-20").cast("timestamp_ntz"), days=5).groupBy("feature").agg(F.count("*").alias("n")),
    "g_limited": lambda s, d: guard.limited(rows(s, d, ACTIVITY).withColumnRenamed("session", "actor"), rows(s, d, VISITORS).where("user_id % 2 = 0").select(F.col("user_id").alias("actor"))).groupBy("actor").agg(F.count("*").alias("n")),
    "t_flat_search": lambda s, d: planner.flat_search(_pages(s, d), corpus.book_dimension(s), "tion the", 8).select("book", "volume", "first_page", "errors"),
    "t_grouped_form": t_grouped_form,
    "t_plan": t_plan,
    "t_ranked": lambda s, d: planner.ranked(rows(s, d, CANDIDATES), rows(s, d, RANKING)).select("query_id", "index", "item", "place", "confidence", "reason"),
    "t_two_tier": t_two_tier,
}

_OPEN = f"SELECT *, CASE WHEN status = 'pending' AND coalesce(expires_at, created_at + INTERVAL 24 HOURS) <= {NOW} THEN 'expired' ELSE status END AS state FROM orders_"
_DAY = "TIMESTAMP '2024-01-01 16:00:00' AND {c} < TIMESTAMP '2024-01-02 16:00:00'"
_MAIL = "lower(trim(email))"

ORACLE_SQL: dict[str, str] = {
    "o_orders_with_plans": with_inputs("SELECT order_id, user_id, name, price FROM o JOIN p USING (plan) JOIN (SELECT user_id, name FROM u) USING (user_id)", o=ORDERS, p=PLANS, u=USERS),
    "o_payment_trail": with_inputs("SELECT e.order_id, event_id, status, name FROM e LEFT JOIN (SELECT * FROM o WHERE status <> 'failed') o USING (order_id) LEFT JOIN u ON u.user_id = o.user_id", e=PAYMENTS, o=ORDERS, u=USERS),
    "o_expire_orders": with_inputs(f"SELECT order_id, state AS status FROM ({_OPEN})", orders_=ORDERS),
    "o_request_orders": with_inputs(
        f"""SELECT user_id, plan, action, CASE WHEN action <> 'refuse' THEN order_id END AS order_id, CASE WHEN action = 'replace' THEN CASE WHEN notes = '' THEN 'price-changed' ELSE notes || '; price-changed' END END AS note
          FROM (SELECT a.user_id, a.plan, h.order_id, h.notes, CASE WHEN NOT coalesce(is_active, false) THEN 'refuse' WHEN h.order_id IS NULL THEN 'create' WHEN h.amount = price THEN 'reuse' ELSE 'replace' END AS action
            FROM asked a LEFT JOIN p ON p.plan = a.plan LEFT JOIN (SELECT * FROM ({_OPEN}) WHERE state = 'pending' QUALIFY row_number() OVER (PARTITION BY user_id, plan ORDER BY created_at DESC, order_id DESC) = 1) h
            ON h.user_id = a.user_id AND h.plan = a.plan)""",
        asked=ASKED, p=PLANS, orders_=ORDERS,
    ),
    "o_mark_paid": with_inputs(
        "SELECT order_id, CASE WHEN status = 'pending' AND e IS NOT NULL THEN 'paid' ELSE status END AS status, CASE WHEN status = 'pending' THEN e END AS paid_by FROM o LEFT JOIN (SELECT order_id, arg_min(event_id, (paid_at, event_id)) AS e FROM pay GROUP BY order_id) USING (order_id)",
        o=ORDERS, pay=PAYMENTS,
    ),
    "o_stacked_memberships": with_inputs(
        """, numbered AS (SELECT *, CAST(epoch(paid_at) AS BIGINT) AS t0, months * 2592000 AS len, row_number() OVER (PARTITION BY user_id ORDER BY paid_at, order_id) AS n FROM paid),
             chain AS (SELECT user_id, order_id, n, t0 AS starts, t0 + len AS ends FROM numbered WHERE n = 1
               UNION ALL SELECT m.user_id, m.order_id, m.n, greatest(m.t0, c.ends), greatest(m.t0, c.ends) + m.len FROM chain c JOIN numbered m ON m.user_id = c.user_id AND m.n = c.n + 1)
           SELECT order_id, starts, ends FROM chain""",
        paid=PAID,
    ).replace("WITH paid", "WITH RECURSIVE paid").replace(") , numbered", "), numbered"),
    "o_active_plans": with_inputs("SELECT user_id, 40 AS days_left FROM m WHERE ends > TIMESTAMP '2024-01-20 12:00:00'", m=MEMBERS),
    "o_dashboard_scalars": with_inputs(
        f"""SELECT (SELECT count(*) FROM u) AS total_users, (SELECT count(*) FROM u WHERE is_active) AS active_accounts, (SELECT count(*) FROM u WHERE verified_at <> '') AS verified_users,
          (SELECT count(*) FROM u WHERE NOT is_active) AS disabled_users, (SELECT count(*) FROM u WHERE created_at >= {_DAY.format(c='created_at')}) AS new_users_today,
          (SELECT sum(amount)::DOUBLE FROM tr WHERE status = 'paid' AND paid_at >= {_DAY.format(c='paid_at')}) AS paid_today, (SELECT count(*) FROM tr WHERE status = 'pending') AS pending_orders,
          (SELECT count(*) FROM tr WHERE status = 'failed') AS payment_errors_today, (SELECT count(*) FROM m WHERE ends > TIMESTAMP '2024-01-02 16:00:00') AS active_members,
          (SELECT count(DISTINCT user_id) FROM today WHERE user_id IN (SELECT user_id FROM m WHERE ends > TIMESTAMP '2024-01-02 16:00:00')) AS member_online_today,
          (SELECT count(DISTINCT session) FROM today) AS today_online, (SELECT count(DISTINCT session) FROM today WHERE ts >= TIMESTAMP '2024-01-02 15:55:00') AS current_online,
          (SELECT count(DISTINCT user_id) FROM today) AS registered_online_today, (SELECT count(*) FROM today WHERE feature = 'search') AS searches_today, (SELECT count(*) FROM today WHERE feature = 'reader') AS reader_views_today,
          (SELECT count(*) FROM today WHERE feature = 'ai') AS ai_requests_today, (SELECT coalesce(sum(amount::DECIMAL(18, 2)), 0)::DOUBLE FROM today WHERE feature = 'ai') AS ai_tokens_today,
          (SELECT count(*) FROM today WHERE feature = 'ai' AND NOT success) AS ai_errors_today, (SELECT count(*) FROM today WHERE feature IN ('pricing', 'pricing_journal')) AS pricing_views_today,
          (SELECT count(*) FROM today WHERE feature = 'pricing_journal') AS pricing_from_journal_today, (SELECT count(*) FROM today WHERE feature = 'ai' AND provider = 'sub') AS sub_requests_today,
          (SELECT coalesce(sum(amount::DECIMAL(18, 2)), 0)::DOUBLE FROM today WHERE feature = 'ai' AND provider = 'sub') AS sub_tokens_today""",
        u=USERS, tr=TRADES, m=MEMBERS, act=ACTIVITY, today=f"SELECT * FROM act WHERE ts >= {_DAY.format(c='ts')}",
    ),
    "o_verify_codes": with_inputs(
        f"""SELECT attempt_id, token_id, CASE WHEN token_id IS NULL THEN 'none' WHEN used_ OR wrong + attempts >= 5 THEN 'refused' WHEN ok THEN 'verified' ELSE 'wrong' END AS outcome
          FROM (SELECT *, coalesce(bool_or(ok) OVER w, false) AS used_, coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w, 0) AS wrong
            FROM (SELECT t.attempt_id, t.tried_at, k.token_id, k.attempts, k.code = t.code AS ok FROM tries t LEFT JOIN (SELECT * FROM tokens WHERE NOT used AND expires_at > {NOW} QUALIFY row_number() OVER (PARTITION BY email ORDER BY created_at DESC, token_id DESC) = 1) k
              ON k.email = lower(trim(t.email))) WINDOW w AS (PARTITION BY token_id ORDER BY tried_at, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        tokens=TOKENS, tries=TRIES,
    ),
    "o_devices": with_inputs("SELECT id, status = 'active' AND expires_at <> 'soon' AS authorized FROM v", v=DEVICES),
    "o_releases": with_inputs("SELECT channel, release_id, coalesce(app_version, '0.1') AS app_version FROM c LEFT JOIN (SELECT * FROM r WHERE is_active QUALIFY row_number() OVER (PARTITION BY channel ORDER BY created_at DESC, release_id DESC) = 1) USING (channel)", c=CHANNELS, r=RELEASES).replace("SELECT channel, release_id, coalesce", "SELECT channel, release_id, coalesce"),
    "o_threads": with_inputs(
        """SELECT thread_id, CASE WHEN coalesce(lu, -1) > coalesce(la, -1) THEN 'needs_reply' ELSE 'answered' END AS status, count(*) FILTER (role = 'user' AND message_id > coalesce(la, -1)) AS unread_admin,
             count(*) FILTER (role = 'admin' AND message_id > coalesce(lu, -1)) AS unread_user, max(created_at) FILTER (role = 'user') AS last_user_message, max(created_at) FILTER (role = 'admin') AS last_admin_message
           FROM (SELECT *, max(message_id) FILTER (role = 'user') OVER (PARTITION BY thread_id) AS lu, max(message_id) FILTER (role = 'admin') OVER (PARTITION BY thread_id) AS la FROM m) GROUP BY thread_id, lu, la""",
        m=MESSAGES,
    ),
    "o_put": with_inputs(
        """SELECT scope, name, arg_max(value, (new, seen)) FILTER (value IS NOT NULL) AS value, arg_max(seen, (new, seen)) AS seen
           FROM (SELECT *, 0 AS new FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY scope, name ORDER BY seen DESC) = 1) UNION ALL SELECT *, 1 AS new FROM c) GROUP BY scope, name""",
        s=SETTINGS, c=CHANGES,
    ),
    "o_put_absent": with_inputs(
        """, cc AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY scope, name ORDER BY seen DESC) = 1), ss AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY scope, name ORDER BY seen DESC) = 1)
           SELECT * FROM cc UNION ALL SELECT * FROM ss WHERE (scope, name) NOT IN (SELECT (scope, name) FROM cc)""",
        s=SETTINGS, c=CHANGES,
    ).replace(") , cc", "), cc"),
    "o_count_up": "SELECT user_id, event_type AS feature, count(*) AS n, max(ts) AS seen FROM events GROUP BY ALL",
    "o_delete_where": with_inputs("SELECT order_id FROM o WHERE status <> 'failed' AND expires_at IS NULL", o=ORDERS),
    "o_find_users": "SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE contains(lower(c_mktsegment), 'build') ORDER BY c_custkey LIMIT 30",
    "o_page": with_inputs("SELECT order_id, plan FROM o WHERE status = 'paid' AND plan IN ('1-URGENT', '2-HIGH') ORDER BY created_at DESC, order_id DESC LIMIT 50", o=ORDERS),
    "a_status_histogram": with_inputs("SELECT plan, status, count(*) AS n FROM o GROUP BY ALL", o=ORDERS),
    "a_distinct_sets": with_inputs("SELECT session, array_to_string(list_sort(list(DISTINCT provider)), ',') AS provider, array_to_string(list_sort(list(DISTINCT feature)), ',') AS feature FROM act GROUP BY session", act=ACTIVITY),
    "a_first_day": "SELECT CAST(CAST(least((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) FROM lineitem), (SELECT min(ts) FROM events)) + INTERVAL 8 HOURS AS DATE) AS VARCHAR) AS day",
    "j_collect_window": with_inputs(
        """SELECT article_id, source, CASE WHEN source_type = 'web_html' AND NOT auto_publish THEN 'pending_review' ELSE 'ready' END AS status FROM w JOIN s USING (source)
           WHERE is_enabled AND title <> 'Masthead' AND CASE length(published_at) WHEN 10 THEN published_at >= '1997-03-15' WHEN 7 THEN published_at || '-28' >= '1997-03-15' WHEN 4 THEN published_at >= '1997' ELSE true END""",
        w=WORKS, s=SOURCES,
    ),
    "j_merge_details": with_inputs(
        """SELECT article_id, abstract, published_at, pages, doi, issue,
             CASE WHEN len(who) = 0 THEN '佚名' ELSE array_to_string(who[1:3], ', ') || CASE WHEN len(who) > 3 THEN CASE WHEN language = 'en' THEN ', et al' ELSE ', 等' END ELSE '' END END || '. ' || title || '[J]. Journal, ' || left(published_at, 4)
             || CASE WHEN volume <> '' AND issue <> '' THEN ', ' || volume || '(' || issue || ')' WHEN volume <> '' THEN ', ' || volume WHEN issue <> '' THEN ', (' || issue || ')' ELSE '' END
             || CASE WHEN pages <> '' THEN ': ' || pages ELSE '' END || CASE WHEN doi <> '' THEN '. DOI: ' || doi ELSE '' END || '.' AS citation
           FROM (SELECT article_id, a.title, a.language, a.volume, coalesce(nullif(a.abstract, ''), d.abstract, '') AS abstract, coalesce(nullif(a.pages, ''), d.pages, '') AS pages, coalesce(nullif(a.doi, ''), d.doi, '') AS doi,
                   coalesce(nullif(a.issue, ''), d.issue, '') AS issue, CASE WHEN d.published_at IS NOT NULL AND (length(a.published_at) = 4 OR a.source_id IS NOT NULL AND ends_with(a.published_at, '-01-01')) THEN d.published_at ELSE a.published_at END AS published_at,
                   list_filter(string_split(coalesce(nullif(a.authors, ''), d.authors, ''), ';'), lambda x: x <> '') AS who FROM a LEFT JOIN d USING (article_id))""",
        a=ARTICLES, d=DETAILS,
    ),
    "j_archive_batches": with_inputs(
        """SELECT CASE WHEN a.status <> 'ignored' AND (a.batch_id IS NULL OR b.status IN ('collecting', 'reviewing', 'ready_to_send')) THEN 'archived' ELSE a.status END AS status, count(*) AS n FROM a LEFT JOIN b USING (batch_id) GROUP BY 1
           UNION ALL SELECT 'batch ' || CASE WHEN status = 'sent' THEN 'sent' ELSE 'archived' END, count(*) FROM b GROUP BY 1""",
        a=BATCHED, b=BATCHES,
    ),
    "j_public_batch": with_inputs("SELECT *, 'sent' AS next FROM b WHERE status = 'sent' ORDER BY created_at DESC, batch_id DESC LIMIT 1", b=BATCHES),
    "j_review_list": with_inputs(
        """SELECT article_id, CASE WHEN discipline IN ('3-MEDIUM', '1-URGENT') THEN discipline ELSE 'other' END AS discipline,
             row_number() OVER (ORDER BY CASE discipline WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, article_id) AS ref FROM r""",
        r=REVIEW,
    ),
    "j_recipients": with_inputs(f"SELECT DISTINCT {_MAIL} AS email FROM a WHERE trim(email) <> '' AND {_MAIL} NOT IN (SELECT {_MAIL} FROM d)", a=ADDRESSES, d=DELIVERED),
    "j_digests": with_inputs(
        """SELECT subscription_id, CASE WHEN trim(email) = '' THEN 'failed' WHEN n IS NULL THEN 'skipped' ELSE 'sent' END AS status, CASE WHEN trim(email) <> '' THEN digest END AS digest, coalesce(n, 0) AS articles
           FROM s LEFT JOIN (SELECT subscription_id, string_agg(title, '; ' ORDER BY r) AS digest, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY article_id) AS r FROM p JOIN w USING (article_id)) WHERE r <= 3 GROUP BY 1) USING (subscription_id)""",
        s=SUBSCRIBERS, p=PAIRS, w=WORKS,
    ),
    "j_backfill_sources": with_inputs(
        """SELECT source, CASE WHEN t THEN d_type ELSE s_type END AS source_type, CASE WHEN t THEN d_issn ELSE s_issn END AS issn, CASE WHEN t THEN d_url ELSE s_url END AS source_url, CASE WHEN t THEN d_config ELSE s_config END AS config, t AS changed
           FROM (SELECT coalesce(s.source, d.source) AS source, d.source_type AS d_type, s.source_type AS s_type, d.issn AS d_issn, s.issn AS s_issn, d.source_url AS d_url, s.source_url AS s_url, d.config AS d_config, s.config AS s_config,
               d.source IS NOT NULL AND (s.source IS NULL OR (lower(s.source_type) = 'manual' AND s.issn = '' AND trim(s.source_url) = '' AND s.config = '{}') OR contains(s.source_url, 'old.example')
                 OR (d.source_type <> 'manual' AND (lower(s.source_type) = 'manual' OR (d.code <> '' AND NOT contains(s.config, d.code))))) AS t FROM s FULL JOIN d ON s.source = d.source)""",
        s=SOURCES, d=DEFAULTS,
    ),
    "j_due": """
      SELECT o_orderkey, o_orderkey % 4 NOT IN (1, 2) OR wd = o_custkey % 7 AS send,
        o_custkey % 13 <> 0 AND (o_orderkey % 4 = 0 OR (o_orderkey % 4 = 3 OR (wd + 1) % 7 = o_custkey % 7) AND NOT (o_orderkey % 4 >= 2 AND o_custkey % 11 <> 0 AND o_custkey % 40 < CASE o_orderkey % 4 WHEN 2 THEN 12 ELSE 26 END)) AS "collect"
      FROM (SELECT *, isodow(o_orderdate) - 1 AS wd FROM orders)""",
    "j_briefs": with_inputs(
        """SELECT article_id, CASE WHEN article_id % 4 = 0 THEN '译名' ELSE title END AS title, replace(authors, ';', '、') AS authors, abstract,
             CASE WHEN language = 'en' THEN 'translation_pending' ELSE 'ready' END AS status FROM a""",
        a=ARTICLES,
    ),
    "g_to_ban": with_inputs("SELECT ip, requests, minute_peak FROM v WHERE actor_type = 'ip' AND requests >= 20 AND minute_peak >= 2 AND starts_with(ip, '8.8.') AND ip NOT IN (SELECT ip FROM v WHERE user_id % 10 IN (1, 2))", v=VISITORS),
    "g_online": "SELECT count(DISTINCT user_id) AS online FROM events WHERE ts > TIMESTAMP '2024-01-02 05:00:00' AND ts <= TIMESTAMP '2024-01-02 06:00:00'",
    "g_retained": with_inputs("SELECT feature, count(*) AS n FROM act WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY feature", act=ACTIVITY),
    "g_limited": "SELECT user_id AS actor, count(*) AS n FROM events WHERE user_id % 2 <> 0 GROUP BY user_id",
    "t_plan": with_inputs("SELECT query_id, 'ab|cd' AS quotes, 0 AS fragments, 'k' || query_id AS keywords FROM g", g=GIVEN),
    "t_ranked": with_inputs(
        """SELECT c.query_id, c.index, c.item, r.place, CASE WHEN r.confidence <> 'high' THEN least(100, CAST(CAST(r.confidence AS DOUBLE) AS INT)) END AS confidence, trim(regexp_replace(r.reason, '\\s+', ' ', 'g')) AS reason
           FROM c JOIN (SELECT * FROM r WHERE index <> 'x' QUALIFY row_number() OVER (PARTITION BY query_id, index ORDER BY place) = 1) r ON r.query_id = c.query_id AND CAST(r.index AS INT) = c.index""",
        c=CANDIDATES, r=RANKING,
    ),
}
_STATE = """
SELECT source, language, complete, complete AND (kind <> 'web_html' OR auto_publish) AS auto_send,
  CASE WHEN NOT is_enabled THEN '已停用' WHEN complete AND (kind <> 'web_html' OR auto_publish) THEN '可自动抓取·自动发送' WHEN complete THEN '可自动抓取·人工审核' ELSE '待补充来源' END AS label
FROM (SELECT *, kind <> 'manual' AND NOT (kind = 'openalex' AND issn = '') AND NOT (kind IN ('rss', 'web_html') AND trim(source_url) = '' AND entry_url IS NULL) AND NOT (kind = 'web_html' AND parser IS NULL) AS complete
      FROM (SELECT *, lower(source_type) AS kind FROM s))"""
ORACLE_SQL["j_source_state"] = with_inputs(f"SELECT source, complete, auto_send, label FROM ({_STATE})", s=SOURCES)
ORACLE_SQL["j_completeness"] = with_inputs(f"SELECT language, count(*) AS sources, count(*) FILTER (complete) AS complete, count(*) FILTER (auto_send) AS auto_send FROM ({_STATE}) GROUP BY language", s=SOURCES)
_M = _matches("tionthe")
ORACLE_SQL["t_flat_search"] = _with(_PAGES, _M) + "SELECT book, volume, first_page, 0 AS errors FROM matches_distinct JOIN books USING (book) ORDER BY sort_order, volume, first_page LIMIT 8"
ORACLE_SQL["t_grouped_form"] = (
    _with(_PAGES, _M, _SECTIONS)
    + """, groups AS (
           SELECT g.*, sort_order FROM (
             SELECT h.book, h.volume, h.source_file, coalesce(s.section, '（未识别篇章）') AS section, count(*) AS hits, arg_min(h.first_page, h.ord) AS first_page,
                    arg_min(CASE WHEN s.printed_page IS NOT NULL AND s.printed_page NOT LIKE 'pre-%' THEN 0 ELSE 1 END, h.ord) AS front
             FROM matches_distinct h JOIN sections s ON s.source_file = h.source_file AND s.pdf_page = h.first_page GROUP BY ALL) g JOIN books USING (book)
           ORDER BY sort_order, volume, front, first_page, hits DESC, section LIMIT 30)
         SELECT book, volume, source_file, section, hits, first_page, 'exact' AS match_type, 0 AS errors,
                CASE WHEN (SELECT bool_or(truncated) FROM matches_hits) THEN 'volume_chaptered' ELSE 'grouped' END AS form
         FROM groups WHERE book = 'en' ORDER BY volume, front, first_page, hits DESC, section LIMIT 20"""
)
ORACLE_SQL["t_two_tier"] = _with(_PAGES) + """SELECT source_file, pdf_page FROM (SELECT source_file, pdf_page, CAST(contains(norm, 'tion') AS INT) + CAST(contains(norm, 'thereof') AS INT) + CAST(contains(norm, 'onand') AS INT) + CAST(contains(norm, 'edble') AS INT) AS n FROM corpus)
  WHERE n > 0 ORDER BY n DESC, source_file, pdf_page LIMIT 20"""
