"""Accounts, orders, subscriptions, codes, devices, releases and message threads as folds over snapshots.

Tables are never updated in place: an operator takes the current rows and what happened, and gives the rows after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.fields import email, given, masked

#: Days of a month of membership, hours that an unpaid order waits, tries of a code.
MONTH_DAYS, ORDER_HOURS, TRIES = 30, 24, 5


# -- generic folds, which serve every keyed table of settings, counters and logs ------------------------


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def put(current: DataFrame, incoming: DataFrame, keys: list[str], at: str, fill: bool = True) -> DataFrame:
    """The rows after incoming ones replace those of their keys, the latest by ``at`` counting.

    With ``fill`` a null in a newer row keeps the older value.
    """
    rows = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    order = F.struct(F.col("__new"), F.col(at))
    value = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)) if fill else F.max_by(c, order)
    return rows.groupBy(*keys).agg(*[value(c).alias(c) for c in current.columns if c not in keys]).select(current.columns)


def put_absent(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with those incoming ones whose keys are new; of several of one key any one comes in."""
    new = incoming.join(current.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    return current.unionByName(new.select(current.columns))


def count_up(current: DataFrame, events: DataFrame, keys: list[str], counter: str, at: str) -> DataFrame:
    """Counters after events: one more for each, and the latest time."""
    rows = current.select(*keys, counter, at).unionByName(events.select(*keys, F.lit(1).cast("long").alias(counter), at))
    return rows.groupBy(*keys).agg(F.sum(counter).alias(counter), F.max(at).alias(at))


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows without those that meet a condition; an unknown condition keeps its row."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def update_where(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """The rows with new values where a condition is met; an unknown one leaves its row. Values see the row as it was."""
    met = F.coalesce(condition, F.lit(False))
    return rows.withColumns({c: F.when(met, v).otherwise(F.col(c)).cast(rows.schema[c].dataType) for c, v in values.items()})


def update_from(rows: DataFrame, changes: DataFrame, keys: list[str], order: list[Column], values: list[str], condition: Column | None = None) -> DataFrame:
    """The rows after the first change of their keys in the given order; keys that no row has change nothing.

    A null in a change leaves the value that was. A condition may look at the row (as ``old``) and the change (as ``new``).
    """
    first = latest(changes, keys, order).select(*keys, *values).alias("new")
    joined = rows.alias("old").join(first, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "left")
    met = F.col(f"new.{keys[0]}").isNotNull() if condition is None else F.coalesce(condition, F.lit(False))
    kept = {c: F.when(met & F.col(f"new.{c}").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in values}
    return joined.select(*[kept.get(c, F.col(f"old.{c}")).alias(c) for c in rows.columns])


def page(rows: DataFrame, order: list[Column], limit: int, conditions: dict[str, object] | None = None, members: dict[str, list[object]] | None = None) -> DataFrame:
    """The first rows in an order, where columns equal the conditions given and are among the members given.

    Conditions and lists that are None or empty texts count as not given; an empty list matches nothing.
    """
    for column, value in (conditions or {}).items():
        if value not in (None, ""):
            rows = rows.where(F.col(column) == F.lit(value))
    for column, values in (members or {}).items():
        if values is not None:
            rows = rows.where(F.col(column).isin(*values)) if values else rows.limit(0)
    return rows.orderBy(*order).limit(limit)


def find_users(users: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Users whose name or plan holds a text, whatever its case; all where it is blank."""
    wanted = text.strip().lower()
    rows = users if not wanted else users.where(F.contains(F.lower("name"), F.lit(wanted)) | F.contains(F.lower("plan"), F.lit(wanted)))
    return rows.orderBy("user_id").limit(limit)


def histogram(rows: DataFrame, *columns: str) -> DataFrame:
    """How many rows have each combination of values."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def distinct_sets(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """The sorted distinct values of columns for each key, as text; values are made distinct before they are gathered."""
    out = rows.select(key).distinct()
    for c in columns:
        values = rows.where(F.col(c).isNotNull()).select(key, c).distinct()
        gathered = values.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.col(c).cast("string"))), ",").alias(c))
        out = out.join(gathered, key, "left").withColumn(c, F.coalesce(c, F.lit("")))
    return out


def first_day(*sources: tuple[DataFrame, str], hours: int = 8) -> DataFrame:
    """The first business day that any source's time column has."""
    firsts = [df.agg(F.min(F.to_date(F.col(c).cast("timestamp") + F.expr(f"INTERVAL {hours} HOURS"))).alias("day")) for df, c in sources]
    every = firsts[0]
    for other in firsts[1:]:
        every = every.unionByName(other)
    return every.agg(F.min("day").alias("day"))


# -- orders and memberships ----------------------------------------------------------------------------


def orders_with_plans(orders: DataFrame, plans: DataFrame, users: DataFrame) -> DataFrame:
    return orders.join(plans, "plan").join(users.select("user_id", "name"), "user_id")


def payment_trail(events: DataFrame, orders: DataFrame, users: DataFrame) -> DataFrame:
    """Payment events with their orders and users; events of unknown orders stay."""
    return events.join(orders.select("order_id", "user_id", "status"), "order_id", "left").join(users.select("user_id", "name"), "user_id", "left")


def expire_orders(orders: DataFrame, now: Column) -> DataFrame:
    """Pending orders past their expiry are expired; those without one expire so many hours after they were made."""
    end = F.coalesce("expires_at", F.col("created_at") + F.expr(f"INTERVAL {ORDER_HOURS} HOURS"))
    return orders.withColumn("status", F.when((F.col("status") == "pending") & (end <= now), "expired").otherwise(F.col("status")))


def request_orders(orders: DataFrame, requests: DataFrame, plans: DataFrame, now: Column) -> DataFrame:
    """What becomes of requests (user_id, plan) for an order: action, order_id and note.

    The latest pending order of the user and plan is used again if its amount is the plan's; else it expires
    with a note and a new one is made. Requests for inactive or unknown plans are refused.
    """
    open_ = expire_orders(orders, now).where("status = 'pending'")
    held = latest(open_, ["user_id", "plan"], [F.desc("created_at"), F.desc("order_id")]).select("user_id", "plan", "order_id", F.col("amount").alias("__amount"), F.col("notes").alias("__notes"))
    rows = requests.join(plans.select("plan", "price", "is_active"), "plan", "left").join(held, ["user_id", "plan"], "left")
    same = F.col("__amount") == F.col("price")
    action = F.when(~F.coalesce("is_active", F.lit(False)), "refuse").when(F.col("order_id").isNull(), "create").when(same, "reuse").otherwise("replace")
    note = F.when(action == "replace", F.concat_ws("; ", given(F.col("__notes")), F.lit("price-changed")))
    return rows.select("user_id", "plan", action.alias("action"), F.when(action != "refuse", F.col("order_id")).alias("order_id"), note.alias("note"))


def mark_paid(orders: DataFrame, events: DataFrame) -> DataFrame:
    """Orders after payment events (order_id, event_id, paid_at): only a pending one is paid, by its first event.

    Later events change nothing, so running again gives the same; others keep their state.
    """
    first = latest(events, ["order_id"], [F.asc("paid_at"), F.asc("event_id")]).select("order_id", F.col("event_id").alias("__event"), F.col("paid_at").alias("__paid"))
    rows = orders.join(first, "order_id", "left")
    pays = (F.col("status") == "pending") & F.col("__event").isNotNull()
    new = {"status": F.when(pays, "paid").otherwise(F.col("status")), "paid_by": F.when(pays, F.col("__event")), "paid_at": F.when(pays, F.col("__paid"))}
    return rows.withColumns(new).drop("__event", "__paid")


def stacked_memberships(paid: DataFrame) -> DataFrame:
    """starts and ends of each paid order (user_id, order_id, paid_at, months): a membership begins where the last one ends.

    start = max(paid_at, end before); unrolled, an end is the greatest, over the orders up to this one, of their
    payment plus the months since, so windows compute it without going through the orders one by one.
    """
    order = Window.partitionBy("user_id").orderBy("paid_at", "order_id").rowsBetween(Window.unboundedPreceding, 0)
    seconds = F.col("months") * MONTH_DAYS * 86400
    rows = paid.withColumn("__sum", F.sum(seconds).over(order)).withColumn("__slack", F.max(F.unix_seconds("paid_at") - (F.col("__sum") - seconds)).over(order))
    end = F.col("__slack") + F.col("__sum")
    return rows.select("user_id", "order_id", F.timestamp_seconds(end - seconds).alias("starts"), F.timestamp_seconds(end).alias("ends"))


def days_left(ends: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_seconds(ends) - F.unix_seconds(now)) / 86400)).cast("int")


def active_plans(users: DataFrame, memberships: DataFrame, now: Column) -> DataFrame:
    """Users with a membership at a time, once each, with the plan that lasts longest."""
    valid = memberships.where((F.col("starts") <= now) & (F.col("ends") > now)).groupBy("user_id").agg(F.max("ends").alias("ends"))
    return users.select("user_id").join(valid, "user_id").select("user_id", days_left(F.col("ends"), now).alias("days_left"))


def dashboard(users: DataFrame, orders: DataFrame, memberships: DataFrame, activity: DataFrame, day: str, hours: int = 8) -> DataFrame:
    """The scalars of one business day: accounts, memberships, orders and activity, one grouped pass of each table.

    users: user_id, is_active, verified_at, created_at. orders: status, amount, created_at, paid_at. activity: ts, session,
    user_id, feature, success, amount, provider.
    """
    start = F.lit(day).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    end = start + F.expr("INTERVAL 1 DAY")
    inside = lambda c: (F.col(c) >= start) & (F.col(c) < end)
    today = activity.where(inside("ts"))
    stitched = F.coalesce(F.concat(F.lit("u:"), F.max("user_id").over(Window.partitionBy("session")).cast("string")), F.concat(F.lit("s:"), F.col("session").cast("string")))
    money = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("decimal(18,2)")).cast("double")
    amount = F.col("amount").cast("decimal(18,2)")
    accounts = users.agg(
        F.count("*").alias("total_users"),
        F.count_if("is_active").alias("active_accounts"),
        F.count_if(given(F.col("verified_at")).isNotNull()).alias("verified_users"),
        F.count_if(~F.col("is_active")).alias("disabled_users"),
        F.count_if(inside("created_at")).alias("new_users_today"),
    )
    trade = orders.agg(
        money(F.when((F.col("status") == "paid") & inside("paid_at"), amount)).alias("paid_today"),
        F.count_if(F.col("status") == "pending").alias("pending_orders"),
        F.count_if(F.col("status").isin("failed", "cancelled", "expired") & inside("created_at")).alias("payment_errors_today"),
    )
    valid = memberships.where((F.col("starts") < end) & (F.col("ends") > end)).select("user_id").distinct()
    members = valid.agg(F.count("*").alias("active_members"))
    online = today.join(valid, "user_id", "left_semi").agg(F.count_distinct("user_id").alias("member_online_today"))
    feature = lambda *names: F.count_if(F.col("feature").isin(*names))
    use = today.withColumn("__who", stitched).agg(
        F.count_distinct("__who").alias("today_online"),
        F.count_distinct(F.when(F.col("ts") >= end - F.expr("INTERVAL 5 MINUTES"), F.col("__who"))).alias("current_online"),
        F.count_distinct("user_id").alias("registered_online_today"),
        feature("search").alias("searches_today"),
        feature("reader").alias("reader_views_today"),
        feature("ai").alias("ai_requests_today"),
        money(F.when(F.col("feature") == "ai", amount)).alias("ai_tokens_today"),
        F.count_if((F.col("feature") == "ai") & ~F.col("success")).alias("ai_errors_today"),
        feature("pricing", "pricing_journal").alias("pricing_views_today"),
        feature("pricing_journal").alias("pricing_from_journal_today"),
        F.count_if((F.col("feature") == "ai") & (F.col("provider") == "sub")).alias("sub_requests_today"),
        money(F.when((F.col("feature") == "ai") & (F.col("provider") == "sub"), amount)).alias("sub_tokens_today"),
    )
    # five tables of one row each
    return accounts.join(F.broadcast(trade)).join(F.broadcast(members)).join(F.broadcast(online)).join(F.broadcast(use))


# -- codes, devices, releases, threads -----------------------------------------------------------------


def verify_codes(tokens: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """The outcome of each attempt (attempt_id, email, purpose, code, tried_at), in order of time, against the latest open token.

    Tokens have token_id, email, purpose, code_hash, created_at, expires_at, used, attempts. A token takes so many
    wrong tries and one right one; what follows either is refused.
    """
    open_ = tokens.where(~F.col("used") & (F.col("expires_at") > now)).withColumn("email", email(F.col("email")))
    token = latest(open_, ["email", "purpose"], [F.desc("created_at"), F.desc("token_id")]).select("email", "purpose", "token_id", "code_hash", F.col("attempts").alias("__before"))
    rows = attempts.withColumn("email", email(F.col("email"))).join(token, ["email", "purpose"], "left")
    before = Window.partitionBy("token_id").orderBy("tried_at", "attempt_id").rowsBetween(Window.unboundedPreceding, -1)
    right = F.col("code_hash") == masked(F.col("code"))
    wrong_before = F.coalesce(F.sum(F.when(right, 0).otherwise(1)).over(before), F.lit(0)) + F.col("__before")
    used = F.coalesce(F.max(right).over(before), F.lit(False))
    outcome = F.when(F.col("token_id").isNull(), "none").when(used | (wrong_before >= TRIES), "refused").when(right, "verified").otherwise("wrong")
    return rows.select("attempt_id", "token_id", outcome.alias("outcome"))


def is_authorized(status: Column, expires_at: Column, now: Column) -> Column:
    """Whether a device may sync: active, and without an expiry or before it; an expiry that is no time refuses."""
    own = given(expires_at)
    return F.coalesce(status == "active", F.lit(False)) & (own.isNull() | F.coalesce(F.try_to_timestamp(own) > now, F.lit(False)))


def current_releases(channels: DataFrame, releases: DataFrame, version: str) -> DataFrame:
    """The latest active release of each channel; the given version where there is none."""
    last = latest(releases.where("is_active"), ["channel"], [F.desc("created_at"), F.desc("release_id")])
    return channels.select("channel").distinct().join(last.select("channel", "release_id", "app_version"), "channel", "left").withColumn("app_version", F.coalesce("app_version", F.lit(version)))


def threads(messages: DataFrame) -> DataFrame:
    """State, unread numbers and last times of each thread, from its messages (thread_id, message_id, role, created_at)."""
    last_admin = F.max(F.when(F.col("role") == "admin", F.col("message_id"))).over(Window.partitionBy("thread_id"))
    last_user = F.max(F.when(F.col("role") == "user", F.col("message_id"))).over(Window.partitionBy("thread_id"))
    rows = messages.withColumn("__admin", F.coalesce(last_admin, F.lit(-1))).withColumn("__user", F.coalesce(last_user, F.lit(-1)))
    return rows.groupBy("thread_id").agg(
        F.when(F.max("__user") > F.max("__admin"), "needs_reply").otherwise("answered").alias("status"),
        F.count_if((F.col("role") == "user") & (F.col("message_id") > F.col("__admin"))).alias("unread_admin"),
        F.count_if((F.col("role") == "admin") & (F.col("message_id") > F.col("__user"))).alias("unread_user"),
        F.max(F.when(F.col("role") == "user", F.col("created_at"))).alias("last_user_message"),
        F.max(F.when(F.col("role") == "admin", F.col("created_at"))).alias("last_admin_message"),
    )
