"""Queries of sources by type over the pages table, and their SQL.

Each page is a source of one of five types. Lists are the pages themselves; the other responses say a hash of a page's
whole text. The first candidate of every third feed is broken, so its fallback serves.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.plans.shared import named, rows, with_inputs
from folia.sources import articles

PAGES = "SELECT page_id, concat(coalesce(url, ''), '#', page_id) AS link, html, md5(coalesce(html, '')) AS said, page_id % 5 AS kind, page_id % 3 AS turn FROM {pages}"
_SOURCES = {
    "source": "page_id", "source_type": "CASE kind WHEN 0 THEN 'rss' WHEN 2 THEN 'openalex' WHEN 3 THEN 'crossref' ELSE 'web_html' END", "source_url": "link",
    "issn": "CAST(page_id AS STRING)", "name": "'Pages'", "language": "CAST(NULL AS STRING)",
    "config": """CASE kind WHEN 0 THEN concat('{"fallback_urls": ["feed:', page_id, '"]}') WHEN 4 THEN '{"parser": "ncpssd_journal", "auto_publish": true}' END""",
}
_RSS = "<rss><channel><item><title>First of {0}</title><link>/rss/{0}</link><description>Says &lt;b&gt;{1}&lt;/b&gt;</description><pubDate>2024</pubDate></item><item><title>Second of {0}</title></item></channel></rss>"
_ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Entry of {0}</title><link href="http://example.org/{0}"/><summary>{1}</summary></entry></feed>'
_WORK = {"results": [{"id": "w/{0}", "doi": "https://doi.org/10.1/{0}", "title": "Work of {0}", "type": "article", "publication_date": "2024-01-02", "abstract_inverted_index": {"{1}": [1], "says": [0]}}, {"title": "Data of {0}", "type": "dataset"}]}
_ITEM = {"message": {"items": [{"title": ["Item", "of {0}"], "type": "journal-article", "DOI": "10.2/{0}", "URL": "http://d/{0}", "abstract": "<p>{1}</p>", "published": {"date-parts": [[2023, 5]]}}]}}
_RECORD = "<a onclick=\"openDetail('/Literature/articleinfo?id=QK{0}2021003012')\" title='Record of {0}'>x</a><i class='writer'>{1}[1], N.N.</i><i class='pages'>(3-4)</i>"


def _filled(form: str) -> str:
    """SQL for a form whose places are filled with the page's number and hash."""
    parts = form.replace("'", "\\'").replace("{0}", "', page_id, '").replace("{1}", "', said, '")
    return f"concat('{parts}')"


def _responses(pages: DataFrame) -> DataFrame:
    body = f"""CASE kind WHEN 0 THEN if(turn = 0, '<rss><channel>', {_filled(_RSS)}) WHEN 1 THEN html WHEN 2 THEN {_filled(json.dumps(_WORK))}
               WHEN 3 THEN {_filled(json.dumps(_ITEM))} ELSE {_filled(_RECORD)} END"""
    url = "CASE kind WHEN 2 THEN concat('openalex:', page_id) WHEN 3 THEN concat('crossref:', page_id) ELSE link END"
    own = pages.select(F.expr(url).alias("url"), F.expr(body).alias("body"))
    return own.unionByName(pages.where("kind = 0").select(F.expr("concat('feed:', page_id)").alias("url"), F.expr(_filled(_ATOM)).alias("body")))


def source_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles that the sources give."""
    pages = rows(spark, sf_dir, PAGES)
    sources = pages.select(*[F.expr(sql).alias(name) for name, sql in _SOURCES.items()])
    found = articles.articles(sources, articles.outcomes(sources, _responses(pages), most=None))
    return found.withColumn("authors", F.array_join("authors", "; "))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"s_source_articles": source_articles}

_FIELDS = "source, n, title, url, published_at, abstract, doi, volume, issue, pages, journal, authors, language, requires_review"
#: Links of lists with the characters about them: where a link begins follows from the lengths of all before it.
_LISTS = r"""
    SELECT page_id, link, label, href, k, substring(html, CAST(greatest(start - 239, 1) AS BIGINT), CAST(least(start, 240) + length(x) + 360 AS BIGINT)) AS near
    FROM (SELECT *, sum(length(gap) + length(x)) OVER (PARTITION BY page_id ORDER BY k) - length(x) AS start,
                 trim(regexp_replace(regexp_replace(regexp_replace(x, '(?is)^<a\b[^>]*>|</a>$', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS label, regexp_extract(x, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1) AS href
          FROM (SELECT page_id, link, html, generate_subscripts(xs, 1) AS k, unnest(xs) AS x, unnest(gaps[1:len(xs)]) AS gap
                FROM (SELECT page_id, link, html, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>') AS xs, regexp_split_to_array(html, '(?is)<a\b[^>]*>.*?</a>') AS gaps FROM p WHERE kind = 1)))
"""
_KEPT = """
    SELECT page_id, label, k, near, CASE WHEN href LIKE '/%' THEN regexp_extract(link, '^[a-z]+://[^/?#]+') || href ELSE href END AS url FROM l
    WHERE href <> '' AND length(label) BETWEEN 4 AND 160 AND regexp_matches(label, '[一-鿿A-Za-z]')
"""

ORACLE_SQL: dict[str, str] = {
    "s_source_articles": with_inputs(
        f"""SELECT {_FIELDS} FROM (
        SELECT page_id AS source, CAST(i AS INT) AS n, CASE WHEN turn = 0 THEN 'Entry of ' WHEN i = 0 THEN 'First of ' ELSE 'Second of ' END || page_id AS title,
               CASE WHEN turn = 0 THEN 'http://example.org/' || page_id WHEN i = 0 THEN regexp_extract(link, '^[a-z]+://[^/?#]+') || '/rss/' || page_id ELSE link END AS url,
               CASE WHEN turn <> 0 AND i = 0 THEN '2024' ELSE '' END AS published_at, CASE WHEN turn = 0 THEN said WHEN i = 0 THEN 'Says ' || said ELSE '' END AS abstract,
               '' AS doi, '' AS volume, '' AS issue, '' AS pages, 'Pages' AS journal, '' AS authors, 'zh' AS language, FALSE AS requires_review
        FROM p, (VALUES (0), (1)) AS t(i) WHERE kind = 0 AND (turn <> 0 OR i = 0)
        UNION ALL
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INT), label, url,
               CASE WHEN regexp_matches(near, '(19|20)\\d\\d[-/.年]\\d{{1,2}}[-/.月]\\d{{1,2}}') THEN regexp_extract(near, '((19|20)\\d\\d)[-/.年]', 1) || '-' || lpad(regexp_extract(near, '(19|20)\\d\\d[-/.年](\\d{{1,2}})[-/.月]\\d', 2), 2, '0') || '-' || lpad(regexp_extract(near, '(19|20)\\d\\d[-/.年]\\d{{1,2}}[-/.月](\\d{{1,2}})', 2), 2, '0')
                    WHEN regexp_matches(near, '(19|20)\\d\\d[-/.年]\\d') THEN regexp_extract(near, '((19|20)\\d\\d)[-/.年]\\d', 1) || '-' || lpad(regexp_extract(near, '(19|20)\\d\\d[-/.年](\\d{{1,2}})', 2), 2, '0') || '-01'
                    WHEN regexp_matches(near, '(19|20)\\d\\d') THEN regexp_extract(near, '(19|20)\\d\\d') || '-01-01' ELSE '' END,
               '', '', '', '', '', 'Pages', '', 'zh', TRUE
        FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY k) = 1) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k) <= 25
        UNION ALL
        SELECT page_id, 0, 'Work of ' || page_id, 'w/' || page_id, '2024-01-02', 'says ' || said, '10.1/' || page_id, '', '', '', 'Pages', '', 'en', FALSE FROM p WHERE kind = 2
        UNION ALL
        SELECT page_id, 0, 'Item of ' || page_id, 'http://d/' || page_id, '2023-05-01', said, '10.2/' || page_id, '', '', '', 'Pages', '', 'en', FALSE FROM p WHERE kind = 3
        UNION ALL
        SELECT page_id, 0, 'Record of ' || page_id, regexp_extract(link, '^[a-z]+://[^/?#]+') || '/Literature/articleinfo?id=QK' || page_id || '2021003012', '2021-01-01', '', '', '', '3', '3-4', 'Pages', said || '; N.N.', 'zh', FALSE
        FROM p WHERE kind = 4)""", p=PAGES, l=named(_LISTS), a=_KEPT),
}
