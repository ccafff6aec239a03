"""Queries of updates, ordered hashes and deliveries over the test tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.operators import accounts
from folia.plans.shared import rows, with_inputs
from folia.session import shared_dir
from folia.sources import sinks
from folia.streaming import delivery

ORDERS = "SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day, CAST(NULL AS STRING) AS note FROM {orders}"
#: What items say of their orders: a status for some, a day for others.
CHANGES = """SELECT l_orderkey AS order_id, l_linenumber AS nr, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS status,
CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS day FROM {lineitem}"""


def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders from before a day are expired and say what they were."""
    values = {"status": F.lit("expired"), "note": F.concat_ws(" ", F.lit("was"), "status", "user_id")}
    return accounts.update_where(rows(spark, sf_dir, ORDERS), F.expr("status = 'O' AND day < DATE'1998-01-01'"), values)


def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after the last of their items' changes, where these are later than the order."""
    later = F.col("new.day").isNull() | (F.col("new.day") > F.col("old.day"))
    changes = rows(spark, sf_dir, CHANGES)
    return accounts.update_from(rows(spark, sf_dir, ORDERS), changes, ["order_id"], [F.desc("nr"), F.asc_nulls_last("status"), F.asc_nulls_last("day")], ["status", "day"], F.col("new.order_id").isNotNull() & later)


def ordered_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of all texts of each language, in order."""
    pages = rows(spark, sf_dir, "SELECT lang AS book, 1 AS volume, source AS source_file, doc_id AS pdf_page, text AS raw_text FROM {documents}")
    return sinks.ordered_hashes(pages)


def _refuse(message_id: str, digest_id: str, address: str) -> str | None:
    return "refused" if address.startswith("user3") else None


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's digest to each user of that day, as a stream that is replayed from its start: nothing is sent twice."""
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    table, files = spark.read.parquet(f"{sf_dir}/events.parquet").schema, f"{sf_dir}/events*.parquet"
    for run in ("first", "again"):
        events = spark.readStream.schema(table).option("maxFilesPerTrigger", 1).parquet(files)
        mails = events.select(F.date_format("ts", "yyyy-MM-dd").alias("digest_id"), F.expr("if(user_id % 7 = 0, ' ', concat(' User', user_id, '@Example.org'))").alias("email"))
        query = mails.writeStream.foreachBatch(delivery.deliver(f"{base}/ledger", run, _refuse)).option("checkpointLocation", f"{base}/{run}").trigger(availableNow=True).start()
        query.awaitTermination()
    return delivery.deliveries(delivery.ledger(spark, f"{base}/ledger"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"x_update_where": update_where, "x_update_from": update_from, "k_ordered_hashes": ordered_hashes, "r_deliveries": delivered}

ORACLE_SQL: dict[str, str] = {
    "x_update_where": with_inputs(
        """SELECT order_id, user_id, CASE WHEN m THEN 'expired' ELSE status END AS status, day, CASE WHEN m THEN 'was ' || status || ' ' || user_id ELSE note END AS note
        FROM (SELECT *, coalesce(status = 'O' AND day < DATE '1998-01-01', FALSE) AS m FROM o)""", o=ORDERS),
    "x_update_from": with_inputs(
        """SELECT o.order_id, o.user_id, CASE WHEN m THEN coalesce(n.status, o.status) ELSE o.status END AS status, CASE WHEN m THEN coalesce(n.day, o.day) ELSE o.day END AS day, o.note
        FROM o LEFT JOIN (SELECT f.*, coalesce(f.day IS NULL OR f.day > o2.day, FALSE) AS m
                          FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY nr DESC, status ASC NULLS LAST, day ASC NULLS LAST) = 1) f
                          JOIN o o2 ON o2.order_id = f.order_id) n ON n.order_id = o.order_id""", o=ORDERS, c=CHANGES),
    "r_deliveries": """SELECT digest_id, email, CASE WHEN email LIKE 'user3%' THEN 'failed' ELSE 'sent' END AS status,
        CASE WHEN email LIKE 'user3%' THEN 'refused' END AS error, CAST(CASE WHEN email LIKE 'user3%' THEN 0 ELSE 1 END AS BIGINT) AS times_sent
      FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS digest_id, 'user' || user_id || '@example.org' AS email FROM events WHERE user_id % 7 <> 0)""",
}
