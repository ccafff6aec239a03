"""Clickstream, presence, quotas, orders and membership over activity and order tables.

Activity: actor, ts (timestamp), feature, page, amount. Orders: order_id, user_id, status, amount, ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hours of the business day's zone ahead of UTC.
BUSINESS_HOURS = 8
#: Fixed thresholds from which an actor's day is anomalous.
ANOMALY = {"requests": 300, "images": 200, "minute_peak": 90, "pages": 120, "volumes": 8, "page_run": 60}
#: Days that an order is valid for.
VALID_DAYS = 30


def activity_from_events(events: DataFrame) -> DataFrame:
    """The events table as activity: volumes are the event's hour of day, pages its ``k``."""
    return events.select(
        F.col("user_id").alias("actor"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("feature"),
        F.get_json_object("props", "$.k").cast("int").alias("page"),
        F.col("value").alias("amount"),
    )


def business_day(ts: Column, hours: int = BUSINESS_HOURS) -> Column:
    return F.to_date(ts + F.expr(f"INTERVAL {hours} HOURS"))


def daily_dashboard(activity: DataFrame) -> DataFrame:
    """One row per business day: requests, actors, requests by feature and amounts, in one pass."""
    count = lambda feature: F.count_if(F.col("feature") == feature)
    return activity.groupBy(business_day(F.col("ts")).alias("day")).agg(
        F.count("*").alias("requests"),
        F.count_distinct("actor").alias("actors"),
        count("view").alias("views"),
        count("click").alias("clicks"),
        count("error").alias("errors"),
        F.count_distinct(F.when(F.col("feature") == "purchase", F.col("actor"))).alias("buyers"),
        F.bround(F.coalesce(F.sum(F.when(F.col("feature") == "purchase", F.col("amount").cast("decimal(18,2)"))), F.lit(0)), 2).cast("double").alias("paid"),
    )


def dashboard_history(activity: DataFrame) -> DataFrame:
    """daily_dashboard() for every day from the first to the last, zeros where nothing happened."""
    days = activity.agg(F.min(business_day(F.col("ts"))).alias("a"), F.max(business_day(F.col("ts"))).alias("b"))
    days = days.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(daily_dashboard(activity), "day", "left").fillna(0)


def presence(activity: DataFrame, minutes: int = 15) -> DataFrame:
    """bucket, actors and buyers for each quarter of an hour."""
    bucket = F.window("ts", f"{minutes} minutes")["start"].alias("bucket")
    return activity.groupBy(bucket).agg(F.count_distinct("actor").alias("actors"), F.count_distinct(F.when(F.col("feature") == "purchase", F.col("actor"))).alias("buyers"))


def dense_presence(activity: DataFrame, day: str, minutes: int = 15) -> DataFrame:
    """presence() of one day with all its buckets."""
    spark = activity.sparkSession
    own = activity.where(F.to_date("ts") == F.lit(day).cast("date"))
    step = f"sequence(timestamp'{day} 00:00:00', timestamp'{day} 00:00:00' + INTERVAL 1 DAY - INTERVAL {minutes} MINUTES, INTERVAL {minutes} MINUTES)"
    return spark.range(1).select(F.explode(F.expr(step)).alias("bucket")).join(presence(own, minutes), "bucket", "left").fillna(0)


def minute_peaks(activity: DataFrame) -> DataFrame:
    """The most requests of each actor in one minute."""
    minutes = activity.groupBy("actor", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"))
    return minutes.groupBy("actor").agg(F.max("n").alias("minute_peak"))


def page_runs(activity: DataFrame) -> DataFrame:
    """The longest run of consecutive pages of each actor and feature: distinct pages, numbered islands."""
    pages = activity.where("page > 0").select("actor", "feature", "page").distinct()
    island = F.col("page") - F.row_number().over(Window.partitionBy("actor", "feature").orderBy("page"))
    runs = pages.withColumn("island", island).groupBy("actor", "feature", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("actor", "feature").agg(F.max("n").alias("page_run"))


def actor_profiles(activity: DataFrame) -> DataFrame:
    """What one actor did: requests, distinct features and pages, first and last time."""
    return activity.groupBy("actor").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("feature") == "view").alias("images"),
        F.count_distinct("feature").alias("volumes"),
        F.count_distinct(F.when(F.col("page") > 0, F.concat_ws(":", "feature", "page"))).alias("pages"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def anomalous_actors(activity: DataFrame, limit: int = 30, thresholds: dict[str, int] | None = None) -> DataFrame:
    """Of the 4 * limit busiest actors those over some threshold, the busiest first, at most ``limit``.

    The first limit comes before the filter: a small anomalous actor may be missed, as in the rule.
    """
    most = ANOMALY | (thresholds or {})
    busiest = actor_profiles(activity).orderBy(F.desc("requests"), F.desc("images"), "actor").limit(4 * limit)
    runs = page_runs(activity).groupBy("actor").agg(F.max("page_run").alias("page_run"))
    rows = busiest.join(minute_peaks(activity), "actor", "left").join(runs, "actor", "left").fillna(0, ["minute_peak", "page_run"])
    reasons = F.filter(F.array(*[F.when(F.col(c) >= n, F.lit(c)) for c, n in most.items()]), lambda x: x.isNotNull())
    rows = rows.withColumn("reasons", F.array_join(reasons, ",")).where("reasons <> ''")
    return rows.orderBy(F.desc("requests"), F.desc("images"), "actor").limit(limit)


def latest_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def users_with_latest_order(users: DataFrame, orders: DataFrame) -> DataFrame:
    latest = latest_per_key(orders, "user_id", [F.desc("ts"), F.desc("order_id")])
    return users.join(latest.select("user_id", "order_id", "status"), "user_id", "left")


def members_per_plan(plans: DataFrame, orders: DataFrame, at: str) -> DataFrame:
    """Members of each plan at a time, plans without any included: validity stays in the join condition."""
    moment = F.lit(at).cast("timestamp")
    valid = (F.col("o.ts") <= moment) & (moment < F.col("o.ts") + F.expr(f"INTERVAL {VALID_DAYS} DAYS"))
    return plans.alias("p").join(orders.alias("o"), (F.col("p.plan") == F.col("o.plan")) & valid, "left").groupBy("p.plan").agg(F.count_distinct("o.user_id").alias("members"))


def active_members(users: DataFrame, orders: DataFrame, at: str) -> DataFrame:
    """Users with an order valid at a time."""
    moment = F.lit(at).cast("timestamp")
    valid = (F.col("u.user_id") == F.col("o.user_id")) & (F.col("o.ts") <= moment) & (moment < F.col("o.ts") + F.expr(f"INTERVAL {VALID_DAYS} DAYS"))
    return users.alias("u").join(orders.alias("o"), valid, "left_semi")


def superseded_orders(orders: DataFrame) -> DataFrame:
    """Pending orders that are not the latest of their user and plan."""
    pending = orders.where("status = 'O'")
    keep = pending.groupBy("user_id", "plan").agg(F.max("order_id").alias("order_id")).select("order_id")
    return pending.join(keep, "order_id", "left_anti")


def stitched_actors(sessions: DataFrame) -> DataFrame:
    """Distinct actors of each day, where a session counts as the user it ever had on that day."""
    user = F.max("user_id").over(Window.partitionBy("day", "session"))
    actor = F.coalesce(F.concat(F.lit("u:"), user.cast("string")), F.concat(F.lit("s:"), F.col("session").cast("string")))
    return sessions.withColumn("who", actor).groupBy("day").agg(F.count_distinct("who").alias("actors"))


def top_users(activity: DataFrame, limit: int = 20) -> DataFrame:
    totals = activity.groupBy("actor").agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("requests"))
    return totals.orderBy(F.desc("total"), F.desc("requests"), "actor").limit(limit)


def quota_decisions(activity: DataFrame, limit: float) -> DataFrame:
    """For each request what its actor had used that day before it, and whether that is below the limit.

    A limit of 0 blocks everything.
    """
    before = Window.partitionBy("actor", F.to_date("ts")).orderBy("ts", "page").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col("amount").cast("decimal(18,2)")).over(before), F.lit(0).cast("decimal(18,2)"))
    return activity.select("actor", "ts", used.cast("double").alias("used"), (used < F.lit(limit)).alias("accepted"))


def login_locks(failures: DataFrame, tries: int = 10, minutes: int = 15) -> DataFrame:
    """Failures after which an actor is locked: the tries-th last one is at most so many minutes old."""
    back = F.lag("ts", tries - 1).over(Window.partitionBy("actor").orderBy("ts"))
    return failures.withColumn("since", back).where(F.col("since") >= F.col("ts") - F.expr(f"INTERVAL {minutes} MINUTES")).select("actor", "ts", "since")


def order_states(orders: DataFrame, now: str, days: int = 365) -> DataFrame:
    """Orders after expiry: pending ones older than ``days`` are expired; others keep their state."""
    old = F.col("ts") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    state = F.when((F.col("status") == "O") & old, "expired").when(F.col("status") == "O", "pending").when(F.col("status") == "F", "paid").otherwise("processing")
    return orders.select("order_id", "user_id", state.alias("state"))


def feature_access(users: DataFrame, plan_access: DataFrame, user_access: DataFrame, default: bool = False) -> DataFrame:
    """Effective access of every user and feature: the user's own setting, else the plan's, else the default."""
    features = plan_access.select("feature").unionByName(user_access.select("feature")).distinct()
    rows = users.select("user_id", "plan").crossJoin(F.broadcast(features))
    rows = rows.join(plan_access.withColumnRenamed("allowed", "by_plan"), ["plan", "feature"], "left").join(user_access.withColumnRenamed("allowed", "by_user"), ["user_id", "feature"], "left")
    return rows.select("user_id", "feature", F.coalesce("by_user", "by_plan", F.lit(default)).alias("allowed"))
