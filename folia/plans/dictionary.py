"""Queries of dictionaries over the documents table, and their SQL.

The documents of a language and source are the pages of dictionaries of 3000 pages; every third page begins an entry,
and a page says a hash of its document's whole text. The index lists the entries in four forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.operators import dictionary
from folia.plans.shared import named, rows

NAME, CITED = "大辞典", "《大辞典》，"
#: Pages in order: their dictionary, number from 2, number in Chinese digits and in letters, and what they say.
PAGES = """
SELECT source_file, n, concat('论', translate(CAST(n AS STRING), '0123456789', '零一二三四五六七八九')) AS title,
       concat('Entry ', translate(CAST(n AS STRING), '0123456789', 'abcdefghij')) AS english, md5(coalesce(text, '')) AS said
FROM (SELECT concat(lang, '/', source, '/', CAST(CAST(floor((k - 1) / 3000) AS INT) AS STRING)) AS source_file, CAST((k - 1) % 3000 + 2 AS INT) AS n, text
      FROM (SELECT lang, source, text, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k
            FROM {documents} WHERE lang IS NOT NULL AND source IS NOT NULL) AS d) AS p
"""


def _index(pages: DataFrame) -> DataFrame:
    """Index pages of 60 lines: leaders, two pages, a page on its own line, and titles that go on."""
    line = F.expr("""CASE n % 4 WHEN 0 THEN concat(title, '⋯⋯', n) WHEN 1 THEN concat(title, ' ... ', n, '、', n + 1)
                     WHEN 2 THEN concat(title, '\\n', n) ELSE concat(substring(title, 1, 1), '\\n', substring(title, 2), ' · ', n) END""")
    numbered = pages.where("n % 3 = 1").select("source_file", "n", F.expr("3100 + n div 180").alias("page"), line.alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy("source_file", "page").agg(F.concat(F.lit("词目拼音索引 9\n"), F.when(F.min("n") == 4, "【说明】\nL\n").otherwise(""), lines).alias("text"))


def dictionary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that the index lists."""
    return dictionary.index_entries(_index(rows(spark, sf_dir, PAGES)), NAME, 3002, ("【说明】",))


def dictionary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries with what their pages say."""
    body = rows(spark, sf_dir, PAGES)
    text = F.expr(f"concat(n, ' {NAME}\\n', if(n % 3 = 1, concat(title, ' (', english, ')\\n'), ''), '文', said, '。\\n　　又', said, '马克恩 。')")
    pages = body.select("source_file", F.col("n").alias("page"), text.alias("text"))
    entries = dictionary.build_dictionary(_index(body), pages, NAME, CITED, 3002, ("【说明】",))
    return entries.withColumn("issues", F.array_join("issues", ", "))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"b_dictionary_index": dictionary_index, "b_dictionary_entries": dictionary_entries}

_ENTRIES = f"""WITH p AS ({named(PAGES)}), e AS (
  SELECT p.*, CAST(row_number() OVER (PARTITION BY source_file ORDER BY n) AS INT) AS sort_order, lead(n) OVER (PARTITION BY source_file ORDER BY n) AS next FROM p WHERE n % 3 = 1)"""

ORACLE_SQL: dict[str, str] = {
    "b_dictionary_index": f"{_ENTRIES} SELECT source_file, title, 'L' AS letter, n AS start_page, sort_order FROM e",
    "b_dictionary_entries": f"""{_ENTRIES}, held AS (
      SELECT e.source_file, e.n, max(p.n) AS end_page, string_agg('文' || p.said || '。' || chr(10) || chr(10) || '又' || p.said || '马克思。', '' ORDER BY p.n) AS content
      FROM e JOIN p ON p.source_file = e.source_file AND p.n BETWEEN e.n AND e.n + 2 GROUP BY e.source_file, e.n)
    SELECT source_file, sort_order, title || '-' || n AS slug, title, title AS index_title, title AS norm_title, 'L' AS letter, english, content, n AS start_page, end_page,
           '{CITED}第 ' || CASE WHEN n = end_page THEN CAST(n AS VARCHAR) ELSE n || '-' || end_page END || ' 页。' AS citation, CAST(0.78 AS DOUBLE) AS confidence, FALSE AS needs_review,
           'auto_fix:马克恩->马克思' || CASE WHEN next IS NULL THEN ', next_heading_not_found' ELSE '' END AS issues
    FROM e JOIN held USING (source_file, n)""",
}
