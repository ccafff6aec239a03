"""Queries of the citation search over the documents table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions.text import shingles
from folia.operators import associative, corpus, search
from folia.session import stored

QUERY = "tion the"
#: A citation query long enough to be matched with errors.
LONG_QUERY = "retitioning ouen thx of ntertx"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table, normalised once at ingestion."""
    pages = corpus.normalized(corpus.pages_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return stored(pages, f"pages of {sf_dir}")


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.contents_from_pages(_pages(spark, sf_dir))


def t_group_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    hits = search.distinct_hits(search.exact_hits(pages, QUERY))
    return search.group_hits(hits, pages, corpus.with_sections(pages.select("source_file", "pdf_page", "printed_page"), _contents(spark, sf_dir)), corpus.book_dimension(spark))


def t_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page_of(search.exact_hits(_pages(spark, sf_dir), QUERY).select("book", "volume", "start"), ["book", "volume", "start"], 2, 20)


def t_chapter_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, contents = _pages(spark, sf_dir), _contents(spark, sf_dir)
    return search.chapter_hits(pages, contents, "en/src0", 4, "the", page=1, size=10)


def t_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    hits = search.distinct_hits(search.exact_hits(pages, QUERY))
    return search.citations(hits, pages, corpus.book_dimension(spark)).select("book", "volume", "first_page", "last_page", "citation")


def t_locate_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("quote"))
    return search.locate_quotes(_pages(spark, sf_dir), quotes).groupBy("item_id").agg(F.count("*").alias("places"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "t_exact_count": lambda s, d: search.exact_counts(_pages(s, d), QUERY),
    "t_positions_page_span": lambda s, d: search.match_spans(_pages(s, d), QUERY),
    "t_exact_hits_per_book_limit": lambda s, d: search.exact_hits(_pages(s, d), "the").select("book", "volume", "start", "ord", "truncated"),
    "t_group_hits": t_group_hits,
    "t_book_facets": lambda s, d: search.book_facets(search.exact_hits(_pages(s, d), QUERY), corpus.book_dimension(s)),
    "t_paging": t_paging,
    "t_chaptered_rollup": lambda s, d: search.chapter_counts(_pages(s, d), _contents(s, d), QUERY),
    "t_chapter_hits_page": t_chapter_hits,
    "t_citation": t_citation,
    "t_page_context_lag_lead": lambda s, d: search.page_context(_pages(s, d).drop("norm")),
    "t_context": lambda s, d: _pages(s, d).where(F.contains("norm", F.lit("tionthe"))).select("source_file", "pdf_page", search.context(F.col("raw_text"), QUERY).alias("snippet")),
    "t_locate_benchmark": t_locate_benchmark,
    "t_fuzzy_verify": lambda s, d: search.fuzzy_pages(_pages(s, d), LONG_QUERY),
    "t_shingles": lambda s, d: s.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.posexplode(shingles(F.col("text")))).select("item_id", F.col("pos").alias("n"), F.col("col").alias("shingle")),
    "t_fragment_hits": lambda s, d: associative.fragment_search(_pages(s, d), ["thereone", "tionthe", "an", "ingthe", "edthe"]).select("source_file", "start", "fragment", "score"),
    "t_cooccurrence": lambda s, d: associative.keyword_cooccurrence(_pages(s, d), ["tion the", "ing and", "ed of"]).select("source_file", "distinct_keywords", "start", "end", "score"),
    "t_chapter_focused": lambda s, d: associative.chapter_focused(_pages(s, d), _contents(s, d), ["The", "And"], ["tion the", "ing and"]),
    "t_associative": lambda s, d: associative.locate(_pages(s, d), _contents(s, d), ["Anat with by of nteres atre are."], ["tion the", "ing and"], ["thereone"], ["The"], most=None),
    "j_section_asof": lambda s, d: corpus.with_sections(_pages(s, d).drop("norm"), _contents(s, d)).select("source_file", "pdf_page", "section"),
    "j_chapter_asof": lambda s, d: corpus.with_chapters(_pages(s, d).drop("norm"), _contents(s, d)).select("source_file", "pdf_page", F.col("chapter.title").alias("title"), F.col("chapter.kind").alias("kind")),
    "j_segments": lambda s, d: corpus.segments(_pages(s, d), _contents(s, d)).select("source_file", "segment", "title", "chapter_pdf_page", "first_pdf_page", "last_pdf_page", "norm_start", "norm_end"),
}

# -- SQL ---------------------------------------------------------------------------------------------

_STRIP = r"[\s\x{2000}-\x{206f}\x{2e00}-\x{2e7f}\x{3000}-\x{303f}\x{ff00}-\x{ffef}!-/:-@\[-`{-~]+"
_PAGES = rf"""
pages AS (
  SELECT lang AS book, CAST(substr(source, 4) AS INT) AS volume, lang || '/' || source AS source_file,
         row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS pdf_page, text AS raw_text,
         regexp_replace(text, '{_STRIP}', '', 'g') AS norm
  FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL
), corpus AS (
  SELECT *, CASE WHEN pdf_page % 5 = 0 THEN NULL WHEN pdf_page = 1 AND volume % 2 = 0 THEN 'pre-i' ELSE CAST(pdf_page AS VARCHAR) END AS printed_page,
         coalesce(sum(length(norm)) OVER (PARTITION BY source_file ORDER BY pdf_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page_start
  FROM pages
), toc AS (
  SELECT book, volume, source_file, 'c' || pdf_page || ' ' || left(raw_text, 16) AS title, pdf_page, 1 + ((pdf_page - 1) // 3) % 2 AS level,
         CASE WHEN pdf_page % 7 = 0 THEN 'letter' ELSE 'body' END AS kind, pdf_page AS sort_order
  FROM pages WHERE pdf_page >= 1 + volume % 2 AND (pdf_page - 1 - volume % 2) % 3 = 0
), books(book, citation_title, sort_order) AS (VALUES ('en', 'English Works', 10), ('de', 'German Works', 20), ('fr', 'French Works', 30), ('es', 'Spanish Works', 40))"""


def _matches(query: str, name: str = "matches") -> str:
    n = len(query)
    return f"""
{name} AS (
  SELECT book, volume, source_file, pdf_page AS first_page, page_start + i - 1 AS start, norm, i
  FROM (SELECT *, unnest(list_filter(range(1, length(probe) - {n} + 2), lambda k: substr(probe, CAST(k AS BIGINT), {n}) = '{query}')) AS i
        FROM (SELECT *, norm || left(coalesce(lead(norm, 1) OVER v, '') || coalesce(lead(norm, 2) OVER v, '') || coalesce(lead(norm, 3) OVER v, ''), {n - 1}) AS probe
              FROM corpus WHERE norm <> '' WINDOW v AS (PARTITION BY source_file ORDER BY pdf_page)) WHERE contains(probe, '{query}'))
), {name}_spans AS (
  SELECT m.book, m.volume, m.source_file, m.start, m.first_page,
         (SELECT min(c.pdf_page) FROM corpus c WHERE c.source_file = m.source_file AND c.page_start + length(c.norm) >= m.start + {n}) AS last_page
  FROM {name} m
), {name}_hits AS (
  SELECT *, count(*) OVER (PARTITION BY book) >= 200 AS truncated
  FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY volume, source_file, start) AS ord FROM {name}_spans) WHERE ord <= 200
), {name}_distinct AS (
  SELECT * FROM {name}_hits QUALIFY row_number() OVER (PARTITION BY book, volume, source_file, first_page, last_page ORDER BY ord) = 1
)"""


_SECTIONS = """
sections AS (
  SELECT c.source_file, c.pdf_page, c.printed_page,
         coalesce((SELECT arg_max(t.title, (t.pdf_page, t.level, -t.sort_order)) FROM toc t WHERE t.source_file = c.source_file AND t.pdf_page <= c.pdf_page),
                  (SELECT arg_min(t.title, t.pdf_page) FROM toc t WHERE t.source_file = c.source_file)) AS section
  FROM corpus c
)"""

_CHAPTERS = """
levels AS (
  SELECT source_file, coalesce(CASE WHEN bool_or(kind = 'body' AND level = 2) THEN 2 END, min(CASE WHEN kind = 'body' THEN level END), 1) AS primary_level FROM toc GROUP BY source_file
), picked AS (
  SELECT c.source_file, c.pdf_page, c.page_start, c.norm,
    (SELECT arg_max({'t': t.title, 'p': t.pdf_page, 'k': t.kind}, (t.pdf_page, t.level, t.sort_order)) FROM toc t WHERE t.source_file = c.source_file AND t.pdf_page <= c.pdf_page) AS latest,
    (SELECT arg_max({'t': t.title, 'p': t.pdf_page, 'k': t.kind}, (t.pdf_page, t.level, t.sort_order)) FROM toc t JOIN levels l USING (source_file)
      WHERE t.source_file = c.source_file AND t.pdf_page <= c.pdf_page AND t.kind = 'body' AND t.level <= l.primary_level) AS main,
    (SELECT arg_max({'t': t.title, 'p': t.pdf_page, 'k': t.kind}, (t.pdf_page, t.level, t.sort_order)) FROM toc t WHERE t.source_file = c.source_file AND t.pdf_page <= c.pdf_page AND t.kind = 'body') AS body,
    (SELECT arg_min({'t': t.title, 'p': t.pdf_page, 'k': t.kind}, t.pdf_page) FROM toc t WHERE t.source_file = c.source_file) AS head
  FROM corpus c
), chapters AS (
  SELECT source_file, pdf_page, page_start, norm, CASE WHEN latest.k = 'letter' THEN latest ELSE coalesce(main, body, latest, head) END AS chapter FROM picked
), runs AS (
  SELECT *, sum(changed) OVER (PARTITION BY source_file ORDER BY pdf_page) AS segment
  FROM (SELECT *, coalesce(chapter.t, '（未识别篇章）') AS title, coalesce(chapter.p, 0) AS cp,
               CASE WHEN lag((coalesce(chapter.t, ''), coalesce(chapter.p, 0), coalesce(chapter.k, ''))) OVER (PARTITION BY source_file ORDER BY pdf_page)
                         = (coalesce(chapter.t, ''), coalesce(chapter.p, 0), coalesce(chapter.k, '')) THEN 0 ELSE 1 END AS changed
        FROM chapters)
), segments AS (
  SELECT source_file, CAST(segment AS BIGINT) AS segment, any_value(title) AS title, CASE WHEN any_value(cp) = 0 THEN min(pdf_page) ELSE any_value(cp) END AS chapter_pdf_page,
         min(pdf_page) AS first_pdf_page, max(pdf_page) AS last_pdf_page, CAST(min(page_start) AS BIGINT) AS norm_start, CAST(max(page_start + length(norm)) AS BIGINT) AS norm_end
  FROM runs GROUP BY source_file, segment
)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + "\n"


_M = _matches("tionthe")
ORACLE_SQL: dict[str, str] = {
    "t_exact_count": _with(_PAGES, _M) + "SELECT book, volume, count(*) AS hits FROM matches GROUP BY book, volume",
    "t_positions_page_span": _with(_PAGES, _M) + "SELECT book, volume, source_file, CAST(start AS BIGINT) AS start, first_page, last_page FROM matches_spans",
    "t_exact_hits_per_book_limit": _with(_PAGES, _matches("the")) + "SELECT book, volume, CAST(start AS BIGINT) AS start, ord, truncated FROM matches_hits",
    "t_group_hits": _with(_PAGES, _M, _SECTIONS)
    + """SELECT book, volume, source_file, section, hits, first_page, front FROM (
           SELECT h.book, h.volume, h.source_file, coalesce(s.section, '（未识别篇章）') AS section, count(*) AS hits, arg_min(h.first_page, h.ord) AS first_page,
                  arg_min(CASE WHEN s.printed_page IS NOT NULL AND s.printed_page NOT LIKE 'pre-%' THEN 0 ELSE 1 END, h.ord) AS front
           FROM matches_distinct h JOIN sections s ON s.source_file = h.source_file AND s.pdf_page = h.first_page GROUP BY ALL) JOIN books USING (book)
         ORDER BY sort_order, volume, front, first_page, hits DESC, section LIMIT 30""",
    "t_book_facets": _with(_PAGES, _M) + "SELECT book, sort_order, count(*) AS hits FROM matches_hits JOIN books USING (book) GROUP BY ALL",
    "t_paging": _with(_PAGES, _M)
    + """SELECT book, volume, CAST(start AS BIGINT) AS start FROM matches_hits ORDER BY book, volume, start
         LIMIT 20 OFFSET (SELECT CAST(20 * least(1, greatest(0, ceil(count(*) / 20.0) - 1)) AS BIGINT) FROM matches_hits)""",
    "t_chaptered_rollup": _with(_PAGES, _CHAPTERS)
    + """, texts AS (SELECT c.book, c.volume, s.source_file, s.segment, s.chapter_pdf_page, string_agg(c.norm, '' ORDER BY c.pdf_page) AS t
                     FROM corpus c JOIN segments s ON s.source_file = c.source_file AND c.pdf_page BETWEEN s.first_pdf_page AND s.last_pdf_page GROUP BY ALL),
         counted AS (SELECT *, (length(t) - length(replace(t, 'tionthe', ''))) // 7 AS n FROM texts)
         SELECT book, volume, chapter_pdf_page, CAST(sum(n) AS BIGINT) AS hits FROM counted WHERE n > 0 GROUP BY ROLLUP (book, volume, chapter_pdf_page)""",
    "t_chapter_hits_page": _with(_PAGES, _matches("the"), _CHAPTERS)
    + """SELECT CAST(start AS BIGINT) AS start, first_page AS pdf_page, row_number() OVER (PARTITION BY m.source_file, first_page ORDER BY start) - 1 AS rank
         FROM matches m JOIN segments s ON s.source_file = m.source_file AND start BETWEEN norm_start AND norm_end - 3
         WHERE m.source_file = 'en/src0' AND chapter_pdf_page = 4 ORDER BY start LIMIT 10""",
    "t_citation": _with(_PAGES, _M)
    + """SELECT h.book, h.volume, h.first_page, h.last_page,
           citation_title || ', vol. ' || h.volume || ', Beijing: People''s Press, xxxx, p. ' ||
           CASE WHEN p1 IS NULL THEN CASE WHEN first_page = last_page THEN CAST(first_page AS VARCHAR) ELSE first_page || '-' || last_page END || ' (file page)'
                WHEN p1 = p2 THEN p1 ELSE p1 || '-' || p2 END || '.' AS citation
         FROM (SELECT h.*, (SELECT arg_min(c.printed_page, c.pdf_page) FROM corpus c WHERE c.source_file = h.source_file AND c.pdf_page BETWEEN h.first_page AND h.last_page AND c.printed_page NOT LIKE 'pre-%') AS p1,
                           (SELECT arg_max(c.printed_page, c.pdf_page) FROM corpus c WHERE c.source_file = h.source_file AND c.pdf_page BETWEEN h.first_page AND h.last_page AND c.printed_page NOT LIKE 'pre-%') AS p2
               FROM matches_distinct h) h JOIN books USING (book)""",
    "t_page_context_lag_lead": _with(_PAGES)
    + """SELECT source_file, pdf_page, lag(left(raw_text, 240)) OVER v AS previous, lead(left(raw_text, 240)) OVER v AS following FROM pages WINDOW v AS (PARTITION BY source_file ORDER BY pdf_page)""",
    "t_locate_benchmark": _with(_PAGES)
    + f""", quotes AS (SELECT item_id, regexp_replace(left(text, 120), '{_STRIP}', '', 'g') AS q FROM benchmark),
          probes AS (SELECT *, norm || left(coalesce(lead(norm, 1) OVER v, '') || coalesce(lead(norm, 2) OVER v, '') || coalesce(lead(norm, 3) OVER v, ''), 119) AS probe FROM corpus WHERE norm <> '' WINDOW v AS (PARTITION BY source_file ORDER BY pdf_page)),
          met AS (SELECT item_id, book, (length(left(probe, length(norm) + length(q) - 1)) - length(replace(left(probe, length(norm) + length(q) - 1), q, ''))) // length(q) AS n FROM quotes JOIN probes ON contains(probe, q) WHERE length(q) >= 12)
          SELECT item_id, CAST(sum(least(n, 5)) AS BIGINT) AS places FROM (SELECT item_id, book, sum(n) AS n FROM met GROUP BY ALL) WHERE n > 0 GROUP BY item_id""",
    "t_fuzzy_verify": _with(_PAGES)
    + """, probes AS (SELECT *, norm || left(coalesce(lead(norm, 1) OVER v, '') || coalesce(lead(norm, 2) OVER v, '') || coalesce(lead(norm, 3) OVER v, ''), 28) AS probe FROM corpus WHERE norm <> '' WINDOW v AS (PARTITION BY source_file ORDER BY pdf_page)),
          best AS (SELECT book, volume, pdf_page, list_min(list_transform(range(1, length(norm) + 1), lambda a: list_min(list_transform(range(24, 29), lambda n: levenshtein(substr(probe, CAST(a AS BIGINT), CAST(n AS BIGINT)), 'retitioningouenthxofntertx'))))) AS errors
                   FROM probes WHERE contains(probe, 'retitioni') OR contains(probe, 'ngouenthx') OR contains(probe, 'ofntertx'))
          SELECT book, volume, arg_min(pdf_page, (errors, pdf_page)) AS pdf_page, min(errors) AS errors, CAST(floor(100 * (1 - min(errors) / 26)) AS INT) AS score FROM best WHERE errors <= 2 GROUP BY book, volume""",
    "t_shingles": """
      SELECT item_id, n - 1 AS n, g[n] AS shingle FROM (
        SELECT item_id, list_slice(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: x), 1, 8) AS g, unnest(range(1, 9)) AS n FROM (
          SELECT item_id, list_concat(list_concat(
            list_transform(range(1, length(text) - 3), lambda i: substr(text, CAST(i AS BIGINT), 5)), list_transform(range(1, length(text) - 4), lambda i: substr(text, CAST(i AS BIGINT), 6))),
            list_transform(range(1, length(text) - 6), lambda i: substr(text, CAST(i AS BIGINT), 8))) AS l FROM benchmark)) WHERE n <= len(g)""",
    "j_section_asof": _with(_PAGES, _SECTIONS) + "SELECT source_file, pdf_page, section FROM sections",
    "j_chapter_asof": _with(_PAGES, _CHAPTERS) + "SELECT source_file, pdf_page, chapter.t AS title, chapter.k AS kind FROM chapters",
    "j_segments": _with(_PAGES, _CHAPTERS) + "SELECT * FROM segments",
}
