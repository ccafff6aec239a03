"""Answers to a query as a whole: flat and grouped search with error-tolerant fallback, the form of a response, plans and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.fields import clamp, collapsed, gist_terms
from folia.functions.text import LEAST_FUZZY, LEAST_QUERY, normalize_query, strip, trimmed
from folia.operators import search
from folia.operators.corpus import with_books

# Hits shown directly, groups of a page, and the length up to which a query is counted by chapter.
DIRECT, GROUPS_PAGE, SHORT_QUERY = 8, 20, 4
# Parts of a search plan and how many of each are used.
PLAN = {"quotes": 5, "fragments": 16, "keywords": 16, "chapter_keywords": 8}


def flat_search(pages: DataFrame, books: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """book, volume, first_page and errors of the best hits.

    Exact hits come first by book order and volume. Books without any get error-tolerant ones; where no book
    has exact hits all are error-tolerant, by the number of errors.
    """
    hits = _with_fallback(pages, query)
    rows = with_books(hits, books)
    return rows.orderBy("by_errors", "sort_order", "book", "volume", "first_page").limit(limit).select("book", "volume", "first_page", "errors")


def _with_fallback(pages: DataFrame, query: str) -> DataFrame:
    q = normalize_query(query)
    exact = search.distinct_hits(search.exact_hits(pages, query)).select("book", "volume", "first_page", F.lit(0).alias("errors"))
    if len(q) < max(LEAST_FUZZY, LEAST_QUERY):
        return exact.withColumn("by_errors", F.lit(0))
    loose = search.fuzzy_pages(pages, query).select("book", "volume", F.col("pdf_page").alias("first_page"), "errors")
    held = exact.select("book").distinct()
    both = exact.unionByName(loose.join(held, "book", "left_anti"))
    # one row: whether there is any exact hit
    some = F.broadcast(exact.agg((F.count("*") > 0).alias("__exact")))
    return both.join(some).withColumn("by_errors", F.when(F.col("__exact"), 0).otherwise(F.col("errors"))).drop("__exact")


def display_mode(hits: int, length: int, truncated: bool, groups: int) -> str:
    """The form of a response: by chapter for short queries with many hits or where hits were cut, direct for few, else grouped."""
    if truncated or (hits > DIRECT and length <= SHORT_QUERY):
        return "volume_chaptered"
    return "direct" if 0 < hits <= DIRECT and groups <= GROUPS_PAGE else "grouped"


def grouped_search(pages: DataFrame, sections: DataFrame, books: DataFrame, query: str, book: str = "", page: int = 1) -> tuple[str, DataFrame, DataFrame]:
    """(form, facets, one page of groups). Facets count all books; a book filter comes after them.

    Where no book's exact hits were cut, books without any give their best matches with errors.
    """
    names = ["book", "volume", "source_file", "start", "first_page", "last_page", "ord", "match_type", "errors"]
    exact = search.distinct_hits(search.exact_hits(pages, query))
    cut = not exact.where("truncated").isEmpty()
    hits = exact.select(*names[:7], F.lit("exact").alias("match_type"), F.lit(0).alias("errors"))
    if not cut and len(normalize_query(query)) >= LEAST_FUZZY:
        loose = search.fuzzy_matches(pages, query).join(exact.select("book").distinct(), "book", "left_anti")
        hits = hits.unionByName(loose.withColumn("ord", F.lit(0)).withColumn("match_type", F.lit("fuzzy")).select(names))
    facets = search.book_facets(hits, books)
    groups = search.group_hits(hits, pages, sections, books)
    if book:
        groups = groups.where(F.col("book") == book)
    totals = groups.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.count("*").alias("groups")).first()
    form = display_mode(totals["hits"], len(normalize_query(query)), cut, totals["groups"])
    last = max(1, -(-totals["groups"] // GROUPS_PAGE))
    at = min(max(1, page), last)
    return form, facets, groups.offset((at - 1) * GROUPS_PAGE).limit(GROUPS_PAGE)


def parsed_plan(plan: Column) -> Column:
    """The lists of a search plan in JSON, each cut to its length; texts shorter than two characters when normalised go."""
    held = F.from_json(plan, ", ".join(f"{name} array<string>" for name in PLAN))
    fine = lambda name: F.filter(F.transform(held[name], lambda w: trimmed(w)), lambda w: F.length(strip(w)) >= LEAST_QUERY)
    return F.struct(*[F.slice(F.coalesce(fine(name), F.array().cast("array<string>")), 1, most).alias(name) for name, most in PLAN.items()])


def ranked(candidates: DataFrame, ranking: DataFrame) -> DataFrame:
    """Candidates (query_id, index, ...) in the order of a ranking (query_id, place, index, confidence, reason in text).

    Entries whose index is no candidate's or comes again are dropped; confidence is held to 0 to 100, or null.
    """
    own = ranking.withColumn("index", F.expr("try_cast(index AS INT)")).withColumn("confidence", clamp(F.expr("try_cast(confidence AS INT)"), 0, 100))
    first = Window.partitionBy("query_id", "index").orderBy("place")
    own = own.where("index IS NOT NULL").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return candidates.join(own.withColumn("reason", F.left(collapsed(F.col("reason")), F.lit(200))), ["query_id", "index"])


def two_tier(first: DataFrame, pages: DataFrame, gist: str) -> DataFrame:
    """The first tier's rows (source_file, pdf_page), or where there are none, pages that hold the most of the gist's own terms."""
    if not first.isEmpty():
        return first
    terms = pages.sparkSession.range(1).select(F.explode(gist_terms(F.lit(gist))).alias("term")).select(strip(F.col("term")).alias("term"))
    held = pages.join(F.broadcast(terms), F.contains("norm", F.col("term")))
    return held.groupBy("source_file", "pdf_page").agg(F.count_distinct("term").alias("terms")).orderBy(F.desc("terms"), "source_file", "pdf_page").limit(20).select("source_file", "pdf_page")
