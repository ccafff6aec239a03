"""Delivery of digests from a stream, with a ledger: what was sent isn't sent again, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions.fields import email

LEDGER = "message_id string, digest_id string, email string, status string, error string"
#: Takes message_id, digest_id and email of one message and gives an error, None where it was sent.
Send = Callable[[str, str, str], str | None]


def _exists(spark: SparkSession, path: str) -> bool:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All attempts so far: message_id, digest_id, email, status (sent, failed) and error, of every batch that was ended."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(folder)


def due(mails: DataFrame, held: DataFrame) -> DataFrame:
    """message_id, digest_id and email of mails (digest_id, email) that no ledger has as sent, each once.

    Addresses are lower-cased and trimmed; null and blank ones, and null digests, are no mails. A message_id depends on the
    digest and address alone, so that a mail server can tell the second try of a lost task.
    """
    rows = mails.select("digest_id", email(F.col("email")).alias("email")).where("email <> '' AND digest_id IS NOT NULL").distinct()
    rows = rows.select(F.sha2(F.to_json(F.struct("digest_id", "email")), 256).alias("message_id"), "digest_id", "email")
    return rows.join(held.where("status = 'sent'").select("message_id"), "message_id", "left_anti")


def deliver(folder: str, run: str, send: Send) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: sends what is due of a batch and adds the outcomes to the ledger in ``folder``.

    A batch of a run that was ended is passed over when it comes again; one that died is sent anew but for what other
    batches sent. Failed mails are due again when they come again. A lost task sends its mails once more, under
    their message_ids.
    """

    def attempt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            errors = [send(*row) for row in frame[["message_id", "digest_id", "email"]].itertuples(index=False)]
            yield frame.assign(status=["sent" if e is None else "failed" for e in errors], error=errors)

    def batch(mails: DataFrame, number: int) -> None:
        spark, path = mails.sparkSession, f"{folder}/run={run}/batch={number}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            due(mails, ledger(spark, folder)).mapInPandas(attempt, LEDGER).write.mode("overwrite").parquet(path)

    return batch


def deliveries(held: DataFrame) -> DataFrame:
    """The state of each digest and address after all attempts: sent if any was, else failed with its last error by text."""
    sent = F.bool_or(F.col("status") == "sent")
    return held.groupBy("digest_id", "email").agg(F.when(sent, "sent").otherwise("failed").alias("status"), F.when(~sent, F.max("error")).alias("error"), F.count_if(F.col("status") == "sent").alias("times_sent"))
