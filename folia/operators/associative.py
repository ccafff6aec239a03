"""Associative search: fragments, keyword co-occurrence, chapter-focused passages, and their merged evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.text import LEAST_QUERY, normalize_query, strip
from folia.operators.corpus import segments, with_offsets, with_sections
from folia.operators.search import exact_hits, match_spans
from folia.operators.terms import term_places

#: Fixed limits of the reference behaviour.
WINDOW = 200
FRAGMENT_LENGTHS, FRAGMENTS, MOST_FREQUENT, PER_FRAGMENT = (4, 16), 24, 300, 10
CHAPTERS, CANDIDATES, QUOTES = 16, 300, 3


def unique_terms(terms: list[str], least: int = LEAST_QUERY, most: int | None = None, longest: int | None = None) -> list[str]:
    """Normalised terms in order, each once."""
    found = dict.fromkeys(q for t in terms if len(q := normalize_query(str(t or ""))) >= least and (longest is None or len(q) <= longest))
    return list(found)[:most]


def _disjoint(spans: DataFrame) -> DataFrame:
    """Of the occurrences of each term those that a left-to-right scan without overlap finds."""
    order = Window.partitionBy("source_file", "term").orderBy("start")
    gap = spans.withColumn("gap", F.when(F.col("start") - F.lag("start").over(order) < F.col("length"), 0).otherwise(1))
    run = gap.withColumn("run", F.sum("gap").over(order))
    # inside a run of overlapping starts each kept one is the first that is a length or more after the last kept
    far = lambda s, x: (F.size(s) == 0) | (x - F.element_at(s, -1) >= F.col("length"))
    kept = F.aggregate(F.array_sort("starts"), F.array().cast("array<bigint>"), lambda s, x: F.when(far(s, x), F.array_append(s, x)).otherwise(s))
    keys = ["book", "volume", "source_file", "term", "length"]
    return run.groupBy(*keys, "run").agg(F.collect_list("start").alias("starts")).select(*keys, F.explode(kept).alias("start"))


def occurrences(pages: DataFrame, terms: list[str]) -> DataFrame:
    """Disjoint occurrences of each term, found in one pass over texts: book, volume, source_file, term, length, start."""
    rows = term_places(pages, terms)
    lapping = [i for i, t in enumerate(terms) if any(t.startswith(t[k:]) for k in range(1, len(t)))]
    if not lapping:
        return rows
    own = F.col("term").isin(lapping)
    return rows.where(~own).unionByName(_disjoint(rows.where(own)).select(rows.columns))


def fragment_search(pages: DataFrame, fragments: list[str], most: int | None = PER_FRAGMENT) -> DataFrame:
    """Exact places of fragments of 4 to 16 characters: the first ``most`` of each (None: all), none of those with over 300, which tell nothing."""
    terms = unique_terms(fragments, FRAGMENT_LENGTHS[0], FRAGMENTS, FRAGMENT_LENGTHS[1])
    rows = occurrences(pages, terms)
    term = Window.partitionBy("term")
    names = F.array(*[F.lit(t) for t in terms])
    few = rows.groupBy("term").agg(F.count("*").alias("many")).where(F.col("many") <= MOST_FREQUENT).select("term")
    rows = rows.join(few, "term", "left_semi")
    if most is not None:
        rows = rows.withColumn("n", F.row_number().over(term.orderBy("book", "volume", "source_file", "start"))).where(F.col("n") <= most)
    score = F.least(F.lit(97), F.lit(56) + 6 * F.col("length"))
    return rows.select("book", "volume", "source_file", "start", (F.col("start") + F.col("length")).alias("end"), F.get(names, F.col("term")).alias("fragment"), score.alias("score"))


def _densest(found: DataFrame, by: list[str], least: int, terms: int, width: int = WINDOW) -> DataFrame:
    """The best window of each group: most distinct terms, then the tightest, then the latest. All occurrences of so many terms count.

    Windows end at an occurrence and hold those that start in the ``width`` characters before. Occurrences
    with one start enter one by one, in the order of terms, so the frame is over a key of both.
    """
    # twice as many keys to a start as terms, so that the first term of the first start is in the frame and the last of the one before isn't
    frame = Window.partitionBy(*by).orderBy(F.col("start") * (2 * terms) + F.col("term")).rangeBetween(-((width - 1) * 2 * terms + terms - 1), 0)
    rows = found.withColumn("distinct_terms", F.size(F.collect_set("term").over(frame))).withColumn("from", F.min("start").over(frame)).withColumn("end", F.col("start") + F.col("length"))
    rows = rows.where(F.col("distinct_terms") >= least)
    best = rows.groupBy(*by).agg(F.max(F.struct("distinct_terms", (F.col("from") - F.col("end")).alias("tight"), "from", "end")).alias("w"))
    return best.select(*by, F.col("w.distinct_terms").alias("distinct_keywords"), F.col("w.from").alias("start"), F.col("w.end").alias("end"))


def keyword_cooccurrence(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """The densest window of each volume that holds at least half of the keywords (two or more)."""
    terms = unique_terms(keywords)
    least = max(2, (len(terms) + 1) // 2)
    rows = occurrences(pages, terms or ["\0\0"])
    best = _densest(rows, ["book", "volume", "source_file"], least if len(terms) > 1 else 1 << 20, max(len(terms), 1))
    return best.withColumn("score", F.least(F.lit(88), F.bround(92 * F.col("distinct_keywords") / max(len(terms), 1)).cast("int")))


def chapter_focused(pages: DataFrame, contents: DataFrame, chapter_keywords: list[str], content_keywords: list[str], most: int | None = CHAPTERS) -> DataFrame:
    """Passages inside chapters whose title holds a keyword: source_file, start, end, score and keyword.

    A chapter reaches over the deeper ones that follow. Inside it the densest window of content keywords
    counts, else its first 120 characters. Chapters inside one already taken are skipped, which is decided
    volume by volume in order; ``most`` chapters are kept in the order of books, or all of them for None.
    """
    titles, terms = unique_terms(chapter_keywords), unique_terms(content_keywords)
    rows = segments(pages, contents)
    order = Window.partitionBy("source_file").orderBy("segment")
    following = F.collect_list(F.struct("level", "norm_end")).over(order.rowsBetween(1, Window.unboundedFollowing))
    stop = F.aggregate(
        following, F.struct(F.lit(True).alias("go"), F.col("norm_end").alias("end")),
        lambda s, x: F.when(s["go"] & (x["level"] > F.col("level")), F.struct(F.lit(True).alias("go"), x["norm_end"].alias("end"))).otherwise(F.struct(F.lit(False).alias("go"), s["end"].alias("end"))),
        lambda s: s["end"],
    )
    title = strip(F.col("title"))
    hit = F.get(F.filter(F.array(*[F.lit(t) for t in titles]), lambda t: F.contains(title, t)), F.lit(0)) if titles else F.lit(None).cast("string")
    found = rows.withColumn("until", stop).withColumn("keyword", hit).where("keyword IS NOT NULL")
    # greedy cover in order of start
    kept = F.aggregate(
        F.array_sort(F.collect_list(F.struct("norm_start", "until", "keyword"))),
        F.array().cast("array<struct<norm_start:bigint,until:bigint,keyword:string>>"),
        lambda s, x: F.when((F.size(s) == 0) | (x["norm_start"] >= F.element_at(s, -1)["until"]), F.array_append(s, x)).otherwise(s),
    )
    chapters = found.groupBy("book", "volume", "source_file").agg(kept.alias("k")).select("book", "volume", "source_file", F.explode("k").alias("k")).select("book", "volume", "source_file", "k.*")
    if most is not None:
        chapters = chapters.orderBy("book", "volume", "source_file", "norm_start").limit(most)
    if terms:
        # chapters of a volume are apart, so the last that begins at an occurrence or before is the only one that may hold it
        begins = chapters.select("source_file", F.col("norm_start").alias("start"), "until", F.struct("norm_start", "until").alias("chapter"), F.lit(0).alias("__o"))
        rows = occurrences(pages, terms).drop("book", "volume").withColumn("__o", F.lit(1)).unionByName(begins, allowMissingColumns=True)
        order = Window.partitionBy("source_file").orderBy("start", "__o", "until").rowsBetween(Window.unboundedPreceding, 0)
        inside = rows.withColumn("chapter", F.last("chapter", ignorenulls=True).over(order)).where("__o = 1 AND start + length <= chapter.until")
        inside = inside.select("source_file", "term", "start", "length", "chapter.norm_start")
        best = _densest(inside, ["source_file", "norm_start"], 1, len(terms))
        chapters = chapters.join(best, ["source_file", "norm_start"], "left")
    else:
        chapters = chapters.select("*", *(F.lit(None).cast("bigint").alias(c) for c in ("distinct_keywords", "start", "end")))
    score = F.when(F.col("start").isNull(), 86).otherwise(F.least(F.lit(100), 90 + 3 * F.col("distinct_keywords"))).cast("int")
    return chapters.select(
        "book", "volume", "source_file", F.coalesce("start", "norm_start").alias("start"), F.coalesce("end", F.least("until", F.col("norm_start") + 120)).alias("end"), score.alias("score"), "keyword"
    )


def _at_page(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds first_page, the page on which a hit starts, by carrying page starts forward in one order."""
    offsets = with_offsets(pages).select("source_file", F.col("page_start").alias("start"), F.col("pdf_page"), F.lit(0).alias("__o"))
    rows = hits.withColumn("__o", F.lit(1)).unionByName(offsets, allowMissingColumns=True)
    order = Window.partitionBy("source_file").orderBy("start", "__o", "pdf_page").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("first_page", F.last("pdf_page", ignorenulls=True).over(order)).where("__o = 1").drop("__o", "pdf_page")


def locate(pages: DataFrame, contents: DataFrame, quotes: list[str], keywords: list[str], fragments: list[str], chapter_keywords: list[str], most: int | None = CANDIDATES) -> DataFrame:
    """All evidence merged by volume and first page: the best base score, +3 for each further piece of
    evidence, up to +18 for chapter keywords in the section's title, at most 100; best first. Equal scores of
    a volume come in the order of their first kind of evidence: quotes, fragments, chapters, keywords.

    With ``most``, so many pages come, from the reference's numbers of places of quotes and fragments and of chapters; for None all pages,
    from all places and chapters.
    """
    whole = most is None
    columns = ["book", "volume", "source_file", "start", "score", "evidence", "kind"]
    parts: list[DataFrame] = []
    pool = list(fragments)
    for n_quote, quote in enumerate(quotes[:QUOTES]):
        hits = match_spans(pages, quote[:120]) if whole else exact_hits(pages, quote[:120], 5)
        parts.append(hits.withColumn("score", F.lit(100)).withColumn("evidence", F.lit(f"quote:{quote[:24]}")).withColumn("kind", F.lit(n_quote)).select(columns))
        text = normalize_query(quote)
        pool += list(dict.fromkeys(text[i : i + n] for n in (5, 6, 8) for i in range(len(text) - n + 1)))[:8]
    if unique_terms(pool, FRAGMENT_LENGTHS[0], FRAGMENTS, FRAGMENT_LENGTHS[1]):
        parts.append(fragment_search(pages, pool, None if whole else PER_FRAGMENT).withColumn("evidence", F.concat(F.lit("frag:"), "fragment")).withColumn("kind", F.lit(QUOTES)).select(columns))
    if unique_terms(chapter_keywords):
        parts.append(chapter_focused(pages, contents, chapter_keywords, keywords, None if whole else CHAPTERS).withColumn("evidence", F.concat(F.lit("chapter:"), "keyword")).withColumn("kind", F.lit(QUOTES + 1)).select(columns))
    parts.append(keyword_cooccurrence(pages, keywords).withColumn("evidence", F.lit("kw")).withColumn("kind", F.lit(QUOTES + 2)).select(columns))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    merged = _at_page(rows, pages).groupBy("book", "volume", "source_file", "first_page").agg(F.max("score").alias("base"), F.count_distinct("evidence").alias("evidence"), F.min("kind").alias("kind"))
    sections = with_sections(pages.select("source_file", "pdf_page"), contents).select("source_file", F.col("pdf_page").alias("first_page"), "section")
    titles = unique_terms(chapter_keywords)
    matched: Column = sum((F.contains(strip(F.col("section")), F.lit(t)).cast("int") for t in titles), F.lit(0))
    boost = F.least(F.lit(18), 6 * F.coalesce(matched, F.lit(0)))
    score = F.least(F.lit(100), F.col("base") + 3 * (F.col("evidence") - 1) + boost).cast("int")
    out = merged.join(sections, ["source_file", "first_page"], "left").select("book", "volume", "source_file", "first_page", score.alias("score"), "evidence", "kind")
    out = out.orderBy(F.desc("score"), "book", "volume", "kind", "first_page")
    return (out if whole else out.limit(most)).drop("kind")
