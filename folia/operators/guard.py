"""Who may read: blocked agents, exemptions, bans, limits and what is kept of the traces."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.fields import email, given, is_public_ip
from folia.functions.text import quoted, trimmed

# Parts of user agents that are refused.
BLOCKED_AGENTS = (
    "gptbot", "oai-searchbot", "chatgpt-user", "claudebot", "claude-web", "anthropic-ai", "ccbot", "bytespider", "amazonbot", "google-extended",
    "perplexitybot", "perplexity-ai", "diffbot", "imagesiftbot", "omgili", "omgilibot", "dataforseobot", "applebot-extended",
    "meta-externalagent", "meta-externalfetcher", "facebookbot", "cohere-ai", "youbot", "petalbot", "timpibot", "scrapy",
    "curl/", "wget/", "python-requests", "python-urllib", "aiohttp", "httpx/", "go-http-client", "java/", "okhttp", "libwww-perl", "lwp::", "node-fetch",
    "axios/", "guzzlehttp", "winhttp", "apache-httpclient", "httpclient", "mechanize", "postmanruntime", "insomnia", "httrack", "wpull", "colly",
)
# Requests of a day and of a minute from which an address is banned.
BAN_DAILY, BAN_MINUTE = 2000, 90
#: Days that events are kept, hours of presence, minutes within which an actor is online.
EVENT_DAYS, PRESENCE_HOURS, ONLINE_MINUTES = 30, 48, 5


def is_blocked_agent(agent: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether a user agent is refused: an empty one, or one that holds a blocked part, whatever its case."""
    own = F.lower(trimmed(F.coalesce(agent, F.lit(""))))
    return (own == "") | own.rlike("|".join(map(quoted, BLOCKED_AGENTS + more)))


def is_exempt(user_id: Column, address: Column, agent: Column, ip: Column, emails: tuple[str, ...], users: tuple[str, ...], agents: tuple[str, ...], ips: tuple[str, ...]) -> Column:
    """Whether a request is the own monitoring's: by account, else by a part of the agent or by address."""
    own = F.lower(F.coalesce(agent, F.lit("")))
    tests = [email(F.coalesce(address, F.lit(""))).isin(*emails), user_id.cast("string").isin(*users), ip.isin(*ips), *[F.contains(own, F.lit(a)) for a in agents]]
    return reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests])


def online(activity: DataFrame, now: Column, minutes: int = ONLINE_MINUTES) -> DataFrame:
    """Actors seen in the last minutes."""
    return activity.where((F.col("ts") > now - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("ts") <= now)).agg(F.count_distinct("actor").alias("online"))


def to_ban(actors: DataFrame, bans: DataFrame, exempt: DataFrame, daily: int = BAN_DAILY, minute: int = BAN_MINUTE) -> DataFrame:
    """Of actors (actor_type, ip, requests, minute_peak) the public addresses over both limits, neither banned nor exempt."""
    rows = actors.where((F.col("actor_type") == "ip") & (F.col("requests") >= daily) & (F.col("minute_peak") >= minute) & given(F.col("ip")).isNotNull())
    rows = rows.join(bans.select("ip"), "ip", "left_anti").join(exempt.select("ip"), "ip", "left_anti")
    return rows.where(is_public_ip(F.col("ip"))).select("ip", "requests", "minute_peak")


def retained(rows: DataFrame, at: str, now: Column, **age: int) -> DataFrame:
    """Rows not older than an age, as retained(rows, "ts", now, days=30)."""
    (unit, number), *_ = age.items()
    return rows.where(F.col(at) >= now - F.expr(f"INTERVAL {number} {unit.upper()}"))


def limited(activity: DataFrame, exempt: DataFrame) -> DataFrame:
    """Requests that a limit applies to: those of actors that aren't exempt."""
    return activity.join(exempt.select("actor"), "actor", "left_anti")


def summary_or_detail(groups: DataFrame, licensed: bool) -> DataFrame:
    """Groups of hits with their hits, or for callers without a licence only with their number."""
    return groups if licensed else groups.groupBy("book", "volume", "section").agg(F.sum("hits").alias("hits"))
