"""Queries of contents, rules and places over the documents table, and their SQL.

Each language and source is a volume; every third page begins an entry. The contents page, marks and heads are
written from these, so the entries that must be found are known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions.sql import register_functions
from folia.operators import contents, corrections
from folia.plans.search import _M, _PAGES, QUERY, _with
from folia.plans.search import _pages as normal_pages
from folia.plans.shared import named, rows

#: Pages of a volume in order, the letters of their number, and a name for each.
PAGES = """
SELECT source_file, n, text, translate(CAST(n AS STRING), '0123456789', 'abcdefghij') AS letters, md5(concat(source_file, ' ', CAST(n AS STRING))) AS name
FROM (SELECT concat(lang, '/', source) AS source_file, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n, text
      FROM {documents} WHERE lang IS NOT NULL AND source IS NOT NULL) AS p
"""
#: Pages in front of the first: a title page, the contents and a blank one.
FRONT = 3
TITLE = "concat(letters, ' of ', source_file, ' is the part where it goes on')"


def contents_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries parsed from a contents page with leaders, ranges, lines that go on, and pages that only marks know."""
    body = rows(spark, sf_dir, PAGES)
    line = F.expr(f"""CASE n % 4 WHEN 0 THEN concat({TITLE}, ' ........ ', n) WHEN 1 THEN concat({TITLE}, '  ', n, '—', n + 2)
                      WHEN 2 THEN concat({TITLE}, '……', n) ELSE concat('on the whole\\n', {TITLE}, ' ', n) END""")
    listed = body.where("n % 3 = 1").groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))
    front = listed.select("source_file", F.lit(2).alias("pdf_page"), F.concat(F.lit("目 录\n插图\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("raw_text"))
    printed = F.expr("CASE WHEN n % 5 <> 0 THEN CAST(n AS STRING) END")
    pages = body.select("source_file", F.expr(f"CAST(n + {FRONT} AS INT)").alias("pdf_page"), F.col("text").alias("raw_text"), printed.alias("printed_page"))
    pages = pages.unionByName(front.withColumn("printed_page", F.lit(None).cast("string")))
    # numbers and dashes alone are no titles, so that marks are not taken for the contents, however many there are
    marks = body.where("n % 10 = 0").select("source_file", F.col("n").cast("int").alias("mark_no"), F.concat(F.lit("— "), F.col("n"), F.lit(" —")).alias("title"), F.expr(f"CAST(n + {FRONT} AS INT)").alias("pdf_page"), F.lit(1).alias("level"))
    entries = spark.createDataFrame([], "source_file string, title string, pdf_page int, level int, sort_order int")
    return contents.chosen_contents(entries, pages, marks)


def titles_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles at the heads of pages; every third title has an error."""
    body = rows(spark, sf_dir, PAGES)
    pages = body.select("source_file", F.col("n").cast("int").alias("pdf_page"), F.expr(f"if(n % 3 = 1, concat({TITLE}, '\n', coalesce(text, '')), concat('- ', text))").alias("raw_text"))
    title = F.expr(f"if(n % 9 = 1, replace({TITLE}, ' is the', ' us the'), {TITLE})")
    entries = body.where("n % 3 = 1").select("source_file", F.expr("CAST(n div 3 AS INT)").alias("entry_no"), title.alias("title"))
    return contents.located_entries(entries, pages)


def titles_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and marks that say the same but for a character, numbered apart."""
    body = rows(spark, sf_dir, PAGES).where("n % 3 = 1")
    titles = body.select("source_file", F.col("n").alias("title_no"), F.col("name").alias("title"))
    marks = body.where("n % 4 <> 0").select("source_file", (10_000_000 - F.col("n")).alias("mark_no"), F.concat(F.lit("x"), F.expr("substring(name, 2)")).alias("title"))
    # each mark belongs to one title, which must not lose it to a title without any
    return contents.paired_titles(titles, marks, likest_first=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "h_contents_parsed": contents_parsed,
    "b_titles_located": titles_located,
    "j_title_pairs": titles_paired,
}

_BODY = f"WITH p AS ({named(PAGES)})"

ORACLE_SQL: dict[str, str] = {
    "h_contents_parsed": f"""{_BODY}, e AS (
      SELECT source_file, CASE WHEN n % 4 = 3 THEN 'on the whole' ELSE '' END || {TITLE} AS title, CAST(n + {FRONT} AS INT) AS pdf_page
      FROM p WHERE n % 3 = 1 AND (n % 5 <> 0 OR n % 10 = 0) AND n <= 3000
        AND source_file IN (SELECT source_file FROM p WHERE n % 3 = 1 AND n <= 3000 GROUP BY source_file HAVING count(*) >= 3))
    SELECT source_file, title, pdf_page, 1 AS level, CAST(row_number() OVER (PARTITION BY source_file ORDER BY pdf_page, title) AS INT) AS sort_order, 'parsed' AS origin FROM e""",
    "b_titles_located": f"""{_BODY}
    SELECT source_file, CAST(n // 3 AS INT) AS entry_no, CASE WHEN n % 9 = 1 THEN replace({TITLE}, ' is the', ' us the') ELSE {TITLE} END AS title, n AS pdf_page FROM p WHERE n % 3 = 1""",
    "j_title_pairs": f"""{_BODY}
    SELECT source_file, n AS title_no, 10000000 - n AS mark_no FROM p WHERE n % 3 = 1 AND n % 4 <> 0""",
}

# -- rules and places --------------------------------------------------------------------------------------

#: A rule for each page from its own first letters; some change nothing, some stand twice, some are found nowhere.
ACCEPTED = """
SELECT CAST(n * 10 + k AS INT) AS accepted_id, source_file AS volume, CAST(n AS INT) AS pdf_page,
       CASE WHEN k = 3 THEN 'zqxzqx' ELSE substr(letters_of, 1, 3 + k % 2) END AS find,
       CASE WHEN n % 7 = 0 THEN substr(letters_of, 1, 3 + k % 2) WHEN k = 3 THEN 'zqxzqy' ELSE concat(substr(letters_of, 2, 2 + k % 2), 'Q') END AS replace
FROM (SELECT source_file, n, REGEXP AS letters_of FROM p0) AS l CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS k
WHERE length(letters_of) > 8
"""


def rules_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each accepted rule, over the letters of each page."""
    body = rows(spark, sf_dir, PAGES)
    accepted = spark.sql(ACCEPTED.replace("REGEXP", "regexp_replace(coalesce(text, ''), '[^A-Za-z]', '')").replace("p0", "{p0}"), p0=body)
    old = accepted.where("accepted_id % 40 = 10").select(F.col("accepted_id").alias("rule_id"), "volume", "pdf_page", "find", "replace", F.lit(1).alias("expected"), F.lit(True).alias("projected"))
    pages = body.select(F.col("source_file").alias("volume"), F.col("n").cast("int").alias("pdf_page"), F.col("text").alias("raw_text"))
    return corrections.merged_rules(old, accepted, pages, member="A-Za-z")


def located_from_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by the table function."""
    register_functions(spark)
    return spark.sql("SELECT source_file, start, first_page, last_page FROM locate(TABLE({pages}), :q)", pages=normal_pages(spark, sf_dir).select("source_file", "pdf_page", "norm"), args={"q": QUERY})


QUERIES |= {"p_rules_merged": rules_merged, "t_locate_sql": located_from_sql}
ORACLE_SQL |= {
    "p_rules_merged": f"""{_BODY}, p0 AS (SELECT * FROM p), c AS ({ACCEPTED.replace("REGEXP", "regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')")}),
      held AS (SELECT c.*, regexp_replace(coalesce(p.text, ''), '[^A-Za-z]', '', 'g') AS seen, find = replace OR length(find) <> length(replace) AS bad,
                      EXISTS (SELECT 1 FROM c o WHERE o.accepted_id % 40 = 10 AND o.volume = c.volume AND o.pdf_page = c.pdf_page AND o.find = c.find AND length(o.find) = length(o.replace)) AS known
               FROM c JOIN p ON p.source_file = c.volume AND p.n = c.pdf_page),
      timed AS (SELECT *, (length(seen) - length(replace(seen, find, ''))) // length(find) AS times FROM held),
      firsts AS (SELECT *, min(CASE WHEN NOT bad AND NOT known AND times > 0 THEN accepted_id END) OVER (PARTITION BY volume, pdf_page, find) AS f FROM timed),
      stated AS (SELECT *, CASE WHEN bad THEN 'degenerate' WHEN known OR f < accepted_id THEN 'duplicate' WHEN times = 0 THEN 'unmatched' ELSE 'added' END AS state FROM firsts)
    SELECT accepted_id, volume, pdf_page, find, replace, state, CASE WHEN state = 'added' THEN CAST(times AS INT) END AS expected FROM stated""",
    "t_locate_sql": _with(_PAGES, _M) + "SELECT source_file, CAST(start AS BIGINT) AS start, first_page, last_page FROM matches_spans",
}
