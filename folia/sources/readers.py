"""Readers: page tables of either schema, sidecar JSON lines, manifests, feeds and extracted page files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions.text import nfkc

SIDECAR = "pdf_page int, text string"
RSS_ITEM = "title string, link string, pubDate string, description string"
#: Feed items that are read of one document.
ITEMS = 25


def read_pages(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """A page table; one without source_file takes it from the manifest by book and volume."""
    pages = spark.read.parquet(path)
    if "source_file" in pages.columns:
        return pages
    if manifest is None:
        return pages.withColumn("source_file", F.concat_ws("/", "book", F.col("volume").cast("string")))
    return pages.join(F.broadcast(manifest.select("book", "volume", "source_file")), ["book", "volume"], "left")


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Recognised text of scanned pages: one JSON object a line; broken lines and those without text are left out."""
    return spark.read.schema(SIDECAR).option("mode", "DROPMALFORMED").json(path).where("text IS NOT NULL AND pdf_page IS NOT NULL")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """book, volume, source_file of a CSV manifest; rows whose volume is no number are left out, paths use slashes."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select("book", F.expr("try_cast(volume AS INT)").alias("volume"), F.replace("source_file", F.lit("\\"), F.lit("/")).alias("source_file")).where("volume IS NOT NULL")


def volume_from_name(name: Column) -> Column:
    """The volume that a file's name tells: of the patterns below the first that gives 1 to 999."""
    patterns = (r"第\s*(\d{1,3})\s*卷", r"卷\s*(\d{1,3})", r"[Vv]ol\.?\s*(\d{1,3})", r"(?<!\d)(\d{1,3})(?!\d)")
    own = nfkc(name)
    found = [F.nullif(F.regexp_extract(own, p, 1), F.lit("")).cast("int") for p in patterns]
    return F.coalesce(*[F.when(n.between(1, 999), n) for n in found])


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """title, link, published and description of feed items, in the order of each file, at most 25 of it."""
    documents = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("xml"))
    items = documents.select("path", F.posexplode(F.slice(F.regexp_extract_all("xml", F.lit("(?s)<item\\b.*?</item>"), F.lit(0)), 1, ITEMS)).alias("n", "item"))
    tag = lambda name: F.trim(F.regexp_replace(F.regexp_extract("item", f"(?s)<{name}\\b[^>]*>(.*?)</{name}>", 1), r"^<!\[CDATA\[|\]\]>$", ""))
    return items.select("path", "n", tag("title").alias("title"), tag("link").alias("link"), tag("pubDate").alias("published"), tag("description").alias("description"))


def allowed(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Pages of the files on a list."""
    return pages.join(files.select("source_file").distinct(), "source_file", "left_semi")
