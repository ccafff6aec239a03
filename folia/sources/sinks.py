"""Sinks: whole and partial rewrites of page tables, versions committed by a pointer, changed rows, and checksums."""

from __future__ import annotations

import uuid
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

#: The prime of ordered hashes: products of it don't leave Python, sums of 100 billion stay within decimals.
PRIME = 2**89 - 1


def write_pages(pages: DataFrame, path: str) -> None:
    """The whole table anew, a folder for each book, sorted so that scans of a volume read few row groups."""
    pages.repartition("book", "volume").sortWithinPartitions("volume", "source_file", "pdf_page").write.mode("overwrite").partitionBy("book").parquet(path)


def replace_books(pages: DataFrame, path: str) -> None:
    """Only the books that pages hold are rewritten; others stay as they are."""
    rows = pages.repartition("book", "volume").sortWithinPartitions("volume", "source_file", "pdf_page")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book").parquet(path)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """source_file, pdf_page and change (added, removed, text, label) of pages that differ."""
    key = ["source_file", "pdf_page"]
    a, b = before.select(*key, F.struct("raw_text", "printed_page").alias("a")), after.select(*key, F.struct("raw_text", "printed_page").alias("b"))
    kind = (
        F.when(F.col("a").isNull(), "added")
        .when(F.col("b").isNull(), "removed")
        .when(~F.col("a.raw_text").eqNullSafe(F.col("b.raw_text")), "text")
        .when(~F.col("a.printed_page").eqNullSafe(F.col("b.printed_page")), "label")
    )
    return a.join(b, key, "full").select(*key, kind.alias("change")).where("change IS NOT NULL")


def checksums(pages: DataFrame) -> DataFrame:
    """Rows of each book and a checksum that does not depend on their order."""
    row = F.xxhash64("source_file", "pdf_page", "raw_text", "printed_page")
    return pages.groupBy("book").agg(F.count("*").alias("rows"), F.bit_xor(row).alias("checksum"))


# -- ordered hashes ------------------------------------------------------------------------------------


@F.pandas_udf(DecimalType(38, 0))
def _number(texts: pd.Series) -> pd.Series:
    """A text's bytes as a number, modulo PRIME."""
    return pd.Series([Decimal(int.from_bytes(t.encode(), "big") % PRIME) for t in texts], dtype=object)


@F.pandas_udf(DecimalType(38, 0))
def _before(numbers: pd.Series, after: pd.Series) -> pd.Series:
    """A number with so many bytes after it, modulo PRIME."""
    return pd.Series([Decimal(int(h) * pow(256, n, PRIME) % PRIME) for h, n in zip(numbers, after, strict=True)], dtype=object)


def ordered_hashes(pages: DataFrame) -> DataFrame:
    """pages, bytes and hash (a decimal number) of each book's text: its UTF-8 bytes in order as one number, modulo PRIME.

    It is the hash of the pages' texts put together, in the order of volume, source_file and pdf_page, wherever pages are
    cut; null texts are empty. Texts stay where they are: only
    their lengths and numbers are put in order, and terms are summed in parts.
    """
    text = F.coalesce("raw_text", F.lit(""))
    order = [F.desc("volume"), F.desc("source_file"), F.desc("pdf_page"), F.desc("number")]
    later = Window.partitionBy("book").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = pages.select("book", "volume", "source_file", "pdf_page", F.octet_length(text).cast("long").alias("size"), _number(text).alias("number"))
    terms = sizes.withColumn("after", F.coalesce(F.sum("size").over(later), F.lit(0))).select("book", "size", _before("number", "after").alias("term"))
    whole = terms.groupBy("book").agg(F.count("*").alias("pages"), F.sum("size").alias("bytes"), F.sum("term").alias("hash"))
    return whole.withColumn("hash", (F.col("hash") % F.lit(str(PRIME)).cast("decimal(38,0)")).cast("string"))


def verification(before: DataFrame, after: DataFrame) -> DataFrame:
    """What an update did to each book: state (same, changed, added, removed), pages before and after, and changed rows.

    Books whose pages are only cut otherwise, or whose labels alone differ, have the same text: state is same, and changed
    tells how many rows differ.
    """
    a, b = (ordered_hashes(p).select("book", F.struct("pages", "hash").alias(n)) for p, n in ((before, "a"), (after, "b")))
    books = before.select("book", "source_file").unionByName(after.select("book", "source_file")).distinct()
    changed = changes(before, after).join(books, "source_file").groupBy("book").agg(F.count("*").alias("changed"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a.hash") == F.col("b.hash"), "same").otherwise("changed")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return a.join(b, "book", "full").join(changed, "book", "left").select("book", state.alias("state"), zero(F.col("a.pages")).alias("pages_before"), zero(F.col("b.pages")).alias("pages_after"), zero(F.col("changed")).alias("changed"))


# -- versions ------------------------------------------------------------------------------------------


def _files(spark: SparkSession, folder: str):  # noqa: ANN202
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    return path, path(folder).getFileSystem(conf), spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), conf)


def commit_version(df: DataFrame, folder: str, name: str) -> str:
    """Writes df as a new version of a table and then, by one atomic rename, makes it the current one; gives its path.

    Readers see the version before until the rename; a write that dies leaves it in place. Old versions stay.
    """
    spark = df.sparkSession
    path, system, context = _files(spark, folder)
    version = f"{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{version}")
    aside = path(f"{folder}/{version}.pointer")
    out = system.create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(aside, path(f"{folder}/{name}.current"), options)
    return f"{folder}/{version}"


def current_version(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The current version of a table; None before the first."""
    path, system, _ = _files(spark, folder)
    pointer = path(f"{folder}/{name}.current")
    if not system.exists(pointer):
        return None
    # a pointer is one short line
    version = spark.read.text(str(pointer)).first()[0]
    return spark.read.parquet(f"{folder}/{version}")
