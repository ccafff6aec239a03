"""Dictionary and table-of-contents lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.text import normalize_query, strip, trimmed


def suggest(entries: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Entries whose title holds the query: exact ones first, then prefixes, then others; short titles first."""
    q = normalize_query(query).lower()
    norm = F.lower(strip(F.col("title")))
    rows = entries.withColumn("norm", norm).where(F.contains("norm", F.lit(q)))
    rank = F.when(F.col("norm") == q, 0).when(F.startswith("norm", F.lit(q)), 1).otherwise(2)
    rows = rows.withColumn("rank", rank).withColumn("length", F.length("norm"))
    return rows.orderBy("rank", "length", "source_file", "pdf_page", "level", "sort_order").limit(limit).select("source_file", "title", "pdf_page", "rank")


def groups_by_letter(entries: DataFrame) -> DataFrame:
    """Entries under their first letter: A to Z, then all others; with their number and titles in order."""
    first = F.upper(F.left(strip(F.col("title")), F.lit(1)))
    rows = entries.withColumn("letter", F.when(first.rlike("^[A-Z]$"), first).otherwise("#"))
    grouped = rows.groupBy("letter").agg(F.count("*").alias("entries"), F.min("title").alias("first_title"), F.max("title").alias("last_title"))
    return grouped.orderBy(F.when(F.col("letter") == "#", 1).otherwise(0), "letter")


def stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.count_distinct("source_file").alias("files"), F.count_if(F.col("level") == 1).alias("top_level"))


def slugs(entries: DataFrame) -> DataFrame:
    """A slug for each title, numbered from 2 where titles share one."""
    slug = F.trim(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))
    rows = entries.withColumn("base", F.when(slug == "", "entry").otherwise(slug))
    n = F.row_number().over(Window.partitionBy("base").orderBy("source_file", "sort_order"))
    return rows.select("source_file", "sort_order", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n)).alias("slug"))


def volumes(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """source_file, pages and entries of every volume, those without entries included."""
    entries = contents.groupBy("source_file").agg(F.count("*").alias("entries"))
    return pages.groupBy("source_file").agg(F.count("*").alias("pages")).join(entries, "source_file", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))


def volume_contents(contents: DataFrame, source_file: str) -> DataFrame:
    """title, pdf_page and level (held to 1 to 6) of one volume's entries that have a title, in order."""
    rows = contents.where((F.col("source_file") == source_file) & (trimmed("title") != "")).orderBy("pdf_page", "sort_order")
    return rows.select("title", "pdf_page", F.least(F.greatest("level", F.lit(1)), F.lit(6)).alias("level"))
