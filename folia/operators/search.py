"""Citation search over pages: exact and error-tolerant matches, groups, facets, chapters and citations.

Pages have book, volume, source_file, pdf_page, printed_page, raw_text and norm. Every operator narrows pages
by containment first, and matches page by page with look-ahead, so volumes are never put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from folia.functions.matching import best_match
from folia.functions.text import LEAST_QUERY, allowed_errors, disjoint_count, normalize, normalize_query, overlapping_count, positions, trimmed
from folia.operators.corpus import NO_CHAPTER, segments, with_books, with_lookahead, with_offsets

#: Exact matches of a book, groups, matches of a quotation in a book, and raw characters of a quotation.
PER_BOOK, GROUPS, PER_QUOTE, QUOTE_LENGTH = 200, 30, 5, 120
#: Characters on which quotations and pages meet.
SEED = 12


def exact_counts(pages: DataFrame, query: str) -> DataFrame:
    """book, volume and hits: overlapping matches, over page boundaries too."""
    q = normalize_query(query)
    if len(q) < LEAST_QUERY:
        return pages.limit(0).select("book", "volume", F.lit(0).cast("long").alias("hits"))
    side = F.lit(len(q) - 1)
    # texts stay where they are: only their edges are put in order, for matches that cross pages
    edges = pages.where("norm <> ''").select("book", "volume", "source_file", "pdf_page", overlapping_count(F.col("norm"), q).alias("own"), F.left("norm", side).alias("head"), F.right("norm", side).alias("tail"))
    after = Window.partitionBy("source_file").orderBy("pdf_page").rowsBetween(1, len(q) - 1)
    crossing = overlapping_count(F.concat("tail", F.left(F.array_join(F.collect_list("head").over(after), ""), side)), q)
    counted = edges.withColumn("hits", F.col("own") + crossing).where("hits > 0")
    return counted.groupBy("book", "volume").agg(F.sum("hits").cast("long").alias("hits"))


def match_spans(pages: DataFrame, query: str) -> DataFrame:
    """A row for each match: where it starts in its volume, its first and last page.

    Texts stay where they are: places found and pages' edges are put in order, for matches that cross pages.
    """
    q = normalize_query(query)
    if len(q) < LEAST_QUERY:
        return with_offsets(pages).limit(0).select("book", "volume", "source_file", F.col("page_start").alias("start"), F.col("pdf_page").alias("first_page"), F.col("pdf_page").alias("last_page"))
    side = F.lit(len(q) - 1)
    rows = pages.where("norm <> ''").select(
        "book", "volume", "source_file", "pdf_page", F.length("norm").cast("long").alias("own"), F.left("norm", side).alias("head"), F.right("norm", side).alias("tail"), positions(F.col("norm"), q).alias("found")
    )
    order = Window.partitionBy("source_file").orderBy("pdf_page")
    rows = rows.withColumn("page_start", F.coalesce(F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("following", F.left(F.array_join(F.collect_list("head").over(order.rowsBetween(1, len(q) - 1)), ""), side))
    rows = rows.withColumn("reach", F.collect_list(F.struct("pdf_page", (F.col("page_start") + F.col("own")).alias("end"))).over(order.rowsBetween(0, len(q) - 1)))
    crossing = F.transform(positions(F.concat("tail", "following"), q), lambda at: at + F.col("own") - F.length("tail"))
    rows = rows.select("book", "volume", "source_file", "pdf_page", "reach", "page_start", F.explode(F.concat(F.transform("found", lambda at: at.cast("long")), crossing)).alias("at"))
    start = F.col("page_start") + F.col("at")
    last = F.get(F.filter("reach", lambda p: p["end"] >= start + len(q)), F.lit(0))["pdf_page"]
    return rows.select("book", "volume", "source_file", start.alias("start"), F.col("pdf_page").alias("first_page"), last.alias("last_page"))


def exact_hits(pages: DataFrame, query: str, limit: int = PER_BOOK) -> DataFrame:
    """match_spans() up to ``limit`` of each book by volume, file and start, with ord and truncated (the book reached the limit)."""
    book = Window.partitionBy("book")
    rows = match_spans(pages, query).withColumn("ord", F.row_number().over(book.orderBy("volume", "source_file", "start"))).where(F.col("ord") <= limit)
    return rows.withColumn("truncated", F.count("*").over(book) >= limit)


def distinct_hits(hits: DataFrame) -> DataFrame:
    """The first hit of each page span: matches on one span have one context and are one hit."""
    span = Window.partitionBy("book", "volume", "source_file", "first_page", "last_page").orderBy("ord")
    return hits.withColumn("__n", F.row_number().over(span)).where("__n = 1").drop("__n")


def group_hits(hits: DataFrame, pages: DataFrame, sections: DataFrame, books: DataFrame, limit: int = GROUPS) -> DataFrame:
    """Hits by volume and section, in display order, at most ``limit`` groups.

    Groups whose first hit has a printed page come before those in front matter; sections are those of the
    hit's first page. Where hits have match_type and errors, exact and other hits are groups of their own, with the
    least errors of each.
    """
    found = ["match_type", "errors"] if "match_type" in hits.columns else []
    page = sections.select("source_file", F.col("pdf_page").alias("first_page"), "section", "printed_page")
    rows = hits.join(page, ["source_file", "first_page"], "left").withColumn("section", F.coalesce("section", F.lit(NO_CHAPTER)))
    front = F.when(F.col("printed_page").isNotNull() & ~F.col("printed_page").startswith("pre-"), 0).otherwise(1)
    grouped = rows.groupBy("book", "volume", "source_file", "section", *found[:1]).agg(
        F.count("*").alias("hits"), F.min_by("first_page", "ord").alias("first_page"), F.min_by(front, F.col("ord")).alias("front"), *(F.min(c).alias(c) for c in found[1:])
    )
    ordered = with_books(grouped, books).orderBy("sort_order", "book", "volume", "front", "first_page", F.desc("hits"), "section")
    return ordered.select("book", "volume", "source_file", "section", "hits", "first_page", "front", *found).limit(limit)


def book_facets(hits: DataFrame, books: DataFrame) -> DataFrame:
    """Hits of each book that has some, with the configured order."""
    return with_books(hits.groupBy("book").agg(F.count("*").alias("hits")), books).select("book", "sort_order", "hits")


def page_of(rows: DataFrame, order: list[Column | str], page: int, size: int) -> DataFrame:
    """One page of ordered rows; the page number is clamped to those there are."""
    rows = rows.persist()
    total = rows.count()
    pages = max(1, -(-total // size))
    page = min(max(1, page), pages)
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def chapter_counts(pages: DataFrame, contents: DataFrame, query: str) -> DataFrame:
    """book, volume, chapter_pdf_page and hits at three levels in one pass: rollup nulls are totals.

    Counts are of disjoint matches inside segments; those that cross a segment's end belong to no chapter.
    Queries that can overlap themselves are counted in segments put together, as disjoint matches depend
    on all before; for others page and look-ahead give the same.
    """
    q = normalize_query(query)
    parts = segments(pages, contents)
    rows = pages.join(parts.select("source_file", "segment", "chapter_pdf_page", "first_pdf_page", "last_pdf_page"), "source_file").where("pdf_page BETWEEN first_pdf_page AND last_pdf_page")
    overlaps = any(q.startswith(q[i:]) for i in range(1, len(q)))
    if overlaps:
        text = rows.groupBy("book", "volume", "source_file", "segment", "chapter_pdf_page").agg(F.array_sort(F.collect_list(F.struct("pdf_page", "norm"))).alias("p"))
        counted = text.withColumn("n", disjoint_count(F.array_join(F.transform("p", lambda x: x["norm"]), ""), q))
    else:
        inside = Window.partitionBy("source_file", "segment").orderBy("pdf_page").rowsBetween(1, max(len(q) - 1, 1))
        following = F.left(F.array_join(F.collect_list(F.left("norm", F.lit(len(q) - 1))).over(inside), ""), F.lit(len(q) - 1))
        counted = rows.where("norm <> ''").withColumn("n", overlapping_count(F.concat("norm", following), q))
    total = counted.where("n > 0").rollup("book", "volume", "chapter_pdf_page").agg(F.sum("n").cast("long").alias("hits"))
    return total if len(q) >= LEAST_QUERY else total.limit(0)


def chapter_hits(pages: DataFrame, contents: DataFrame, source_file: str, chapter_pdf_page: int, query: str, page: int = 1, size: int = 10) -> DataFrame:
    """One page of a chapter's overlapping matches: start, pdf_page and rank, the match's number on its page."""
    volume = pages.where(F.col("source_file") == source_file)
    own = segments(volume, contents.where(F.col("source_file") == source_file)).where(F.col("chapter_pdf_page") == chapter_pdf_page)
    q = normalize_query(query)
    rows = match_spans(volume, query).join(own.select("source_file", "norm_start", "norm_end"), "source_file").where(F.col("start").between(F.col("norm_start"), F.col("norm_end") - len(q)))
    rank = F.row_number().over(Window.partitionBy("source_file", "first_page").orderBy("start")) - 1
    rows = rows.select("start", F.col("first_page").alias("pdf_page"), rank.alias("rank"))
    return page_of(rows, ["start"], page, size)


def citations(hits: DataFrame, pages: DataFrame, books: DataFrame, years: DataFrame | None = None, place: str = "Beijing", publisher: str = "People's Press") -> DataFrame:
    """hits with a citation: title and volume, place, publisher, year (xxxx if unknown) and pages.

    Printed page numbers of the span's ends are given if it has some, else file pages, marked as such. years:
    (source_file, year).
    """
    numbers = pages.select("source_file", "pdf_page", F.when(~F.col("printed_page").startswith("pre-"), F.col("printed_page")).alias("printed"))
    rows = hits.join(numbers, "source_file").where("pdf_page BETWEEN first_page AND last_page")
    rows = rows.groupBy(*hits.columns).agg(
        F.min_by("printed", F.when(F.col("printed").isNotNull(), F.col("pdf_page"))).alias("p1"), F.max_by("printed", F.when(F.col("printed").isNotNull(), F.col("pdf_page"))).alias("p2")
    )
    rows = with_books(rows, books)
    rows = rows.join(years, "source_file", "left") if years is not None else rows.withColumn("year", F.lit(None).cast("string"))
    span = lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string")))
    where = F.when(F.col("p1").isNotNull(), F.concat(F.lit("p. "), span(F.col("p1"), F.col("p2")))).otherwise(F.concat(F.lit("p. "), span(F.col("first_page"), F.col("last_page")), F.lit(" (file page)")))
    text = F.concat("citation_title", F.lit(", vol. "), F.col("volume").cast("string"), F.lit(f", {place}: {publisher}, "), F.coalesce(F.col("year").cast("string"), F.lit("xxxx")), F.lit(", "), where, F.lit("."))
    return rows.select(*hits.columns, text.alias("citation"))


def context(raw: Column, query: str, occurrence: int = 0, pad: int = 40) -> Column:
    """The raw text around one match, with the match marked; the first 200 characters where there is none."""
    kept = [c for c in query if normalize_query(c)]
    pattern = "(?U)" + r"\W*".join(f"\\Q{c}\\E" for c in kept)
    found = F.regexp_extract_all(raw, F.lit(pattern), F.lit(0))
    parts = F.split(raw, pattern, -1)
    at = F.when(F.size(found) > occurrence, F.lit(occurrence)).otherwise(F.lit(0))
    start = F.aggregate(F.slice(parts, F.lit(1), at + 1), F.lit(0), lambda s, p: s + F.length(p)) + F.aggregate(F.slice(found, F.lit(1), at), F.lit(0), lambda s, p: s + F.length(p))
    match = F.get(found, at)
    low = F.greatest(F.lit(0), start - pad)
    marked = F.concat(F.substring(raw, low + 1, start - low), F.lit("[[H]]"), match, F.lit("[[/H]]"), F.substring(raw, start + F.length(match) + 1, F.lit(pad)))
    fallback = F.replace(F.left(raw, F.lit(200)), F.lit("\n"), F.lit(" "))
    return F.when(F.size(found) > 0, trimmed(F.replace(marked, F.lit("\n"), F.lit(" ")))).otherwise(fallback) if kept else fallback


def page_context(pages: DataFrame, excerpt: int = 240) -> DataFrame:
    """Each page with the ends of its neighbours: previous and next."""
    order = Window.partitionBy("source_file").orderBy("pdf_page")
    text = F.left("raw_text", F.lit(excerpt))
    return pages.select("source_file", "pdf_page", F.lag(text).over(order).alias("previous"), F.lead(text).over(order).alias("following"))


#: An odd number for each place of a seed; the same in every process.
_PLACED = np.random.default_rng(12).integers(0, 1 << 64, SEED, np.uint64) | np.uint64(1)
#: Rows of pages whose places leave Python together.
_SLICE = 128


def seed_hashes(text: str) -> np.ndarray:
    """A hash of the SEED characters from each place of a text; of a shorter text none."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = max(len(chars) - SEED + 1, 0)
    out = np.zeros(size, np.uint64)
    for i, factor in enumerate(_PLACED):
        out += chars[i : i + size] * factor
    out ^= out >> np.uint64(32)
    out *= _PLACED[0]
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def _seed_starts(rows: DataFrame) -> DataFrame:
    """keys: a hash of the SEED characters from each place of a page's probe."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                keys = [seed_hashes(text) for text in batch.column("probe").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("source_file"), batch.column("pdf_page"), pa.array(keys, pa.list_(pa.int64()))], ["source_file", "pdf_page", "keys"])

    return rows.select("source_file", "pdf_page", "probe").mapInArrow(f, "source_file string, pdf_page int, keys array<long>")


@F.pandas_udf(LongType())
def _seed_key(texts: pd.Series) -> pd.Series:
    # quotes that are too short have none, wherever Spark filters them
    return pd.Series([None if t is None or len(t) < SEED else int(seed_hashes(t[:SEED])[0]) for t in texts], dtype="Int64")


def locate_quotes(pages: DataFrame, quotes: DataFrame, limit: int = PER_QUOTE) -> DataFrame:
    """Where quotes (item_id, quote) stand word for word: item_id, book, source_file, pdf_page, at most ``limit`` of each book.

    Quotes are cut to 120 raw characters and normalised; shorter than 12 then, they are left out. Pages and
    quotes meet on hashes of 12 characters, the quote's first and every one of the page, so no page is
    compared with all quotes; what meets is compared whole.
    """
    q = quotes.select("item_id", normalize(F.left("quote", F.lit(QUOTE_LENGTH))).alias("q")).where(F.length("q") >= SEED)
    q = q.withColumn("key", _seed_key("q"))
    rows = with_lookahead(pages, QUOTE_LENGTH).select("book", "volume", "source_file", "pdf_page", "probe", F.length("norm").alias("own"))
    starts = _seed_starts(rows).select("source_file", "pdf_page", F.posexplode("keys").alias("at", "key"))
    starts = starts.join(q.select("key").distinct(), "key", "left_semi")
    placed = rows.join(starts, ["source_file", "pdf_page"])
    met = placed.join(q, "key").where(F.expr("at < own AND substring(probe, at + 1, length(q)) = q"))
    rank = F.row_number().over(Window.partitionBy("item_id", "book").orderBy("volume", "source_file", "pdf_page", "at"))
    return met.withColumn("n", rank).where(F.col("n") <= limit).select("item_id", "book", "source_file", "pdf_page", "at")


def fuzzy_matches(pages: DataFrame, query: str) -> DataFrame:
    """The best error-tolerant match of each volume: book, volume, source_file, start, first_page, last_page and errors.

    A match with at most K errors holds one of the query's K + 1 pieces unchanged, so pages without any fall
    out first; edit distances to all parts of what is left are found in bits. The fewest errors count,
    then the first page, then the first place on it.
    """
    q = normalize_query(query)
    most = allowed_errors(len(q))
    if not most:
        return match_spans(pages, "").withColumn("errors", F.lit(0))
    size = -(-len(q) // (most + 1))
    pieces = [q[i : i + size] for i in range(0, len(q), size)]
    longest = len(q) + most
    rows = with_lookahead(with_offsets(pages), longest)
    after = Window.partitionBy("source_file").orderBy("pdf_page").rowsBetween(0, longest - 1)
    rows = rows.withColumn("reach", F.collect_list(F.struct("pdf_page", (F.col("page_start") + F.length("norm")).alias("end"))).over(after))
    rows = rows.where(reduce(or_, [F.contains("probe", F.lit(p)) for p in pieces]))

    @F.pandas_udf("errors int, at long, end long")
    def nearest(probes: pd.Series, own: pd.Series) -> pd.DataFrame:
        found = [best_match(q, probe, most, before) for probe, before in zip(probes, own, strict=True)]
        return pd.DataFrame([f or (None, None, None) for f in found], columns=["errors", "at", "end"]).astype({"errors": "Int32", "at": "Int64", "end": "Int64"})

    rows = rows.withColumn("best", nearest("probe", F.length("norm"))).where("best.errors IS NOT NULL")
    last = F.get(F.filter("reach", lambda p: p["end"] >= F.col("page_start") + F.col("best.end")), F.lit(0))["pdf_page"]
    found = F.struct("best.errors", F.col("pdf_page").alias("first_page"), (F.col("page_start") + F.col("best.at")).alias("start"), last.alias("last_page"))
    best = rows.groupBy("book", "volume", "source_file").agg(F.min(found).alias("b"))
    return best.select("book", "volume", "source_file", "b.start", "b.first_page", "b.last_page", "b.errors")


def fuzzy_pages(pages: DataFrame, query: str) -> DataFrame:
    """The best error-tolerant match of each volume: book, volume, pdf_page, errors and score."""
    best = fuzzy_matches(pages, query).groupBy("book", "volume").agg(F.min(F.struct("errors", F.col("first_page").alias("pdf_page"))).alias("b"))
    score = F.floor(F.lit(100.0) * (1 - F.col("b.errors") / max(1, len(normalize_query(query))))).cast("int")
    return best.select("book", "volume", "b.pdf_page", "b.errors", score.alias("score"))
