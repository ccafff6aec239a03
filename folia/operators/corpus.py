"""The page corpus: pages, their look-ahead, tables of contents, sections, chapters and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.text import normalize

#: Books in their configured order, with the titles that citations use; a table of a few rows.
BOOKS = (("en", "English Works", 10), ("de", "German Works", 20), ("fr", "French Works", 30), ("es", "Spanish Works", 40))
NO_CHAPTER = "（未识别篇章）"
#: The place of books that have no configuration.
UNKNOWN_BOOK = 9999


def book_dimension(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(list(BOOKS), "book string, citation_title string, sort_order int")


def with_books(rows: DataFrame, books: DataFrame) -> DataFrame:
    """Adds sort_order and citation_title; a book that the dimension does not have comes last and is cited by its own name."""
    known = rows.join(books.select("book", F.col("sort_order").alias("__order"), F.col("citation_title").alias("__title")), "book", "left")
    known = known.withColumn("sort_order", F.coalesce("__order", F.lit(UNKNOWN_BOOK))).withColumn("citation_title", F.coalesce("__title", "book"))
    return known.drop("__order", "__title")


def pages_from_documents(documents: DataFrame) -> DataFrame:
    """Documents as pages: a book for each language, a volume for each source."""
    volume = Window.partitionBy("lang", "source").orderBy("doc_id")
    pages = documents.where("lang IS NOT NULL AND source IS NOT NULL").select(
        F.col("lang").alias("book"),
        F.expr("cast(substring(source, 4) AS INT)").alias("volume"),
        F.concat_ws("/", "lang", "source").alias("source_file"),
        F.row_number().over(volume).alias("pdf_page"),
        F.col("text").alias("raw_text"),
    )
    printed = F.when(F.col("pdf_page") % 5 == 0, None).when((F.col("pdf_page") == 1) & (F.col("volume") % 2 == 0), "pre-i").otherwise(F.col("pdf_page").cast("string"))
    return pages.withColumn("printed_page", printed)


def normalized(pages: DataFrame) -> DataFrame:
    """Adds norm; the one place where Unicode folding runs outside the JVM."""
    return pages.withColumn("norm", normalize(F.coalesce("raw_text", F.lit(""))))


def contents_from_pages(pages: DataFrame) -> DataFrame:
    """A table of contents: every third page starts an entry, of alternating level."""
    first = F.col("volume") % 2
    rows = pages.where((F.col("pdf_page") >= 1 + first) & ((F.col("pdf_page") - 1 - first) % 3 == 0))
    return rows.select(
        "book", "volume", "source_file",
        F.concat(F.lit("c"), F.col("pdf_page").cast("string"), F.lit(" "), F.left("raw_text", F.lit(16))).alias("title"),
        "pdf_page",
        F.expr("cast(1 + ((pdf_page - 1) div 3) % 2 AS INT)").alias("level"),
        F.when(F.col("pdf_page") % 7 == 0, "letter").otherwise("body").alias("kind"),
        F.col("pdf_page").alias("sort_order"),
    )


def valid_contents(contents: DataFrame) -> DataFrame:
    """Entries with a title and a page from 1; the level is at least 1."""
    level = F.greatest(F.lit(1), F.coalesce(F.expr("try_cast(level AS INT)"), F.lit(1)))
    return contents.where("trim(title) <> '' AND try_cast(pdf_page AS INT) >= 1").withColumn("level", level)


def with_lookahead(pages: DataFrame, length: int) -> DataFrame:
    """Adds probe: a page's text and the first length - 1 characters that follow it in its volume.

    A match of that length that starts on the page lies in its probe wherever it ends, so volumes are
    never put together. Pages without text start no match and are left out, so they are not counted as following ones.
    """
    pages = pages.where("norm <> ''")
    if length < 2:
        return pages.withColumn("probe", F.col("norm"))
    after = Window.partitionBy("source_file").orderBy("pdf_page").rowsBetween(1, length - 1)
    following = F.left(F.array_join(F.collect_list(F.left("norm", F.lit(length - 1))).over(after), ""), F.lit(length - 1))
    return pages.withColumn("probe", F.concat("norm", following))


def with_offsets(pages: DataFrame) -> DataFrame:
    """Adds page_start, where the page's text begins in its volume's."""
    before = Window.partitionBy("source_file").orderBy("pdf_page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("page_start", F.coalesce(F.sum(F.length("norm").cast("long")).over(before), F.lit(0)))


def with_sections(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """Adds section: the title of the last entry at or before each page, else of the volume's first; null without entries.

    Entries and pages of a volume are put in one order and the last entry is carried forward, so there is
    one shuffle and no range join. Of entries on one page the deepest counts, then the first.
    """
    entry = contents.select("source_file", "pdf_page", F.struct("level", (-F.col("sort_order")).alias("o"), "title").alias("e")).groupBy("source_file", "pdf_page").agg(F.max("e").alias("e"))
    # entries go before the page of the same number
    marked = pages.withColumn("__o", F.lit(1)).withColumn("e", F.lit(None).cast(entry.schema["e"].dataType))
    rows = marked.unionByName(entry.withColumn("__o", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("source_file").orderBy("pdf_page", "__o")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("section", F.last("e.title", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first(F.when(F.col("__o") == 0, F.col("e.title")), ignorenulls=True).over(whole)
    rows = rows.withColumn("section", F.coalesce("section", first))
    return rows.where("__o = 1").drop("__o", "e")


def with_chapters(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """Adds chapter (title, pdf_page, level, kind) by the conditional rule.

    The latest entry if it is a letter; else the latest body entry not deeper than the volume's primary
    level (2 if it has such, else its least); else the latest body entry; else the latest. Pages before
    all entries take the first; volumes without entries have none.
    """
    body = F.when(F.col("kind") == "body", F.col("level"))
    primary = contents.groupBy("source_file").agg(F.coalesce(F.when(F.max((body == 2).cast("int")) == 1, 2), F.min(body), F.lit(1)).alias("primary_level"))
    key = F.struct("pdf_page", "level", "sort_order", "title", "kind")
    entries = contents.join(primary, "source_file")
    entries = entries.groupBy("source_file", "pdf_page").agg(
        F.max(key).alias("latest"),
        F.max(F.when((F.col("kind") == "body") & (F.col("level") <= F.col("primary_level")), key)).alias("main"),
        F.max(F.when(F.col("kind") == "body", key)).alias("body"),
        F.min_by(key, F.col("sort_order")).alias("head"),
    )
    kind = entries.schema["latest"].dataType
    marked = pages.withColumn("__o", F.lit(1))
    for c in ("latest", "main", "body", "head"):
        marked = marked.withColumn(c, F.lit(None).cast(kind))
    rows = marked.unionByName(entries.withColumn("__o", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("source_file").orderBy("pdf_page", "__o")
    until, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in ("latest", "main", "body"):
        rows = rows.withColumn(f"__{c}", F.last(c, ignorenulls=True).over(until))
    rows = rows.withColumn("__head", F.first("head", ignorenulls=True).over(whole))
    chosen = F.when(F.col("__latest.kind") == "letter", F.col("__latest")).otherwise(F.coalesce("__main", "__body", "__latest", "__head"))
    rows = rows.withColumn("chapter", chosen).where("__o = 1")
    return rows.drop("__o", "latest", "main", "body", "head", "__latest", "__main", "__body", "__head")


def segments(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """Runs of pages of one chapter: source_file, segment, title, chapter_pdf_page, kind, level, first_pdf_page, last_pdf_page, norm_start, norm_end."""
    rows = with_chapters(with_offsets(pages), contents)
    rows = rows.select(
        "book", "volume", "source_file", "pdf_page", "page_start",
        (F.col("page_start") + F.length("norm")).alias("page_end"),
        F.coalesce("chapter.title", F.lit(NO_CHAPTER)).alias("title"),
        F.coalesce("chapter.pdf_page", F.lit(0)).alias("chapter_pdf_page"),
        F.coalesce("chapter.kind", F.lit("")).alias("kind"),
        F.coalesce("chapter.level", F.lit(1)).alias("level"),
    )
    order = Window.partitionBy("source_file").orderBy("pdf_page")
    key = F.struct("title", "chapter_pdf_page", "kind")
    changed = F.when(F.lag(key).over(order) == key, 0).otherwise(1)
    rows = rows.withColumn("changed", changed).withColumn("segment", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = rows.groupBy("book", "volume", "source_file", "segment").agg(
        F.first("title").alias("title"), F.first("chapter_pdf_page").alias("chapter_pdf_page"), F.first("kind").alias("kind"), F.min_by("level", "pdf_page").alias("level"),
        F.min("pdf_page").alias("first_pdf_page"), F.max("pdf_page").alias("last_pdf_page"), F.min("page_start").alias("norm_start"), F.max("page_end").alias("norm_end"),
    )
    # a volume without entries is named after its first page
    own = F.when(F.col("chapter_pdf_page") == 0, F.col("first_pdf_page")).otherwise(F.col("chapter_pdf_page"))
    return grouped.withColumn("chapter_pdf_page", own)
