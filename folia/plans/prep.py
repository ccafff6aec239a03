"""Queries of preparation, feeds and lookup, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.operators import corpus, corrections, feeds, lookup, prep
from folia.plans.search import _PAGES, _STRIP, _contents, _with
from folia.plans.search import _pages as _normal_pages
from folia.plans.shared import rows, with_inputs
from folia.sources import readers


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal_pages(spark, sf_dir).drop("norm")


def _shuffled_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents in an order that pages do not follow."""
    return _contents(spark, sf_dir).select("source_file", F.expr("(sort_order * 7) % 31").alias("sort_order"), "pdf_page")


def p_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(
        [(1, None, None, "the ", "THE ", 0), (2, 3, None, "and", "AND", 0), (3, 1, 2, "of", "OF", 1), (4, 2, 2, "in", "IN", 99)],
        "rule_id int, volume int, pdf_page int, find string, replace string, expected int",
    )
    return corrections.apply_corrections(_pages(spark, sf_dir), rules).select("source_file", "pdf_page", F.sha2("corrected", 256).alias("sha"), "applied", "ambiguous")


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    titled = pages.join(feeds.page_titles(pages), "page_id")
    url = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.col("url"))
    return titled.select("page_id", feeds.dedupe_key(F.lit(""), url, F.lit("j"), F.col("title"), F.lit(""), F.lit("")).alias("dedupe_key"), "title")


def f_upsert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _articles(spark, sf_dir)
    status = F.when(F.col("page_id") % 4 == 0, "archived").when(F.col("page_id") % 4 == 1, "ignored").otherwise("ready")
    current = rows.where("page_id % 2 = 0 OR page_id % 4 = 1").select("dedupe_key", "title", status.alias("status"), F.lit(1).alias("seen"))
    incoming = rows.where("page_id % 5 <> 0").select("dedupe_key", F.concat("title", F.lit("*")).alias("title"), F.lit("pending").alias("status"), F.lit(2).alias("seen"))
    return feeds.upsert(current, incoming)


def f_undelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    articles = orders.select(F.col("o_orderkey").alias("article_id"), F.col("o_orderpriority").alias("topic"), F.col("o_orderdate").alias("first_seen"))
    users = spark.read.parquet(f"{sf_dir}/customer.parquet")
    topics = F.element_at(F.array(*[F.lit(t) for t in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]), (F.col("c_nationkey") % 5 + 1).cast("int"))
    subscriptions = users.select(F.col("c_custkey").alias("subscription_id"), topics.alias("topic"), F.lit("1997-01-01").cast("timestamp_ntz").alias("confirmed"))
    log = orders.select(F.col("o_orderkey").alias("article_id"), F.col("o_custkey").alias("subscription_id"), F.when(F.col("o_orderkey") % 2 == 0, "sent").otherwise("failed").alias("status"))
    return feeds.undelivered_counts(articles, subscriptions, log)


NAMES = """
SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'a 第 ' || CAST(p_partkey % 1200 AS STRING) || ' 卷.pdf' WHEN 1 THEN '卷' || CAST(p_partkey % 90 AS STRING) || 'b.pdf' WHEN 2 THEN 'Vol.' || CAST(p_partkey % 50 AS STRING) || ' x'
  WHEN 3 THEN 'foo ' || CAST(p_partkey % 800 AS STRING) || ' bar.pdf' WHEN 4 THEN 'vol 0 part 7' WHEN 5 THEN '12345.pdf' WHEN 6 THEN p_name WHEN 7 THEN '００' || CAST(p_partkey % 9 AS STRING) || '.pdf' ELSE 'vol 4 第 9 卷' END AS name FROM {part}"""
SITES = "SELECT p_partkey AS id, p_name AS find, translate(p_name, 'ie', 'ei') AS replace FROM {part}"


def p_pair_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in which a page differs from its authority: here the text with some letters exchanged."""
    pages = _pages(spark, sf_dir)
    return prep.pair_tiers(prep.aligned_pairs(pages.select("raw_text", F.translate("raw_text", "aeqx", "eaou").alias("auth")), "raw_text", "auth"))


def b_number_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    wrong = F.when(F.col("pdf_page") % 11 == 3, F.col("pdf_page") + 7).when(F.col("pdf_page") % 4 != 0, F.col("pdf_page") - F.when(F.col("pdf_page") > 10, 2).otherwise(1))
    return prep.number_pages(pages.select("source_file", "pdf_page", F.when(wrong >= 1, wrong).alias("detected")), 5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p_gap_fill": lambda s, d: prep.fill_printed_pages(_pages(s, d)).select("source_file", "pdf_page", "filled"),
    "p_corrections": p_corrections,
    "p_bigrams": lambda s, d: prep.bigrams(_pages(s, d), "[A-Za-z]+"),
    "p_pair_tiers": p_pair_tiers,
    "p_validate_sites": lambda s, d: prep.validate_sites(rows(s, d, SITES), prep.bigrams(_pages(s, d), "[A-Za-z]+")),
    "p_tier_crosstab": lambda s, d: prep.validate_sites(rows(s, d, SITES), prep.bigrams(_pages(s, d), "[A-Za-z]+")).groupBy(F.length("find").alias("length"), "ok").agg(F.count("*").alias("n")),
    "b_number_pages": b_number_pages,
    "s_volume_names": lambda s, d: rows(s, d, NAMES).select("id", readers.volume_from_name(F.col("name")).alias("volume")),
    "l_volumes": lambda s, d: lookup.volumes(_pages(s, d), _contents(s, d)),
    "l_volume_contents": lambda s, d: lookup.volume_contents(_contents(s, d), "en/src0"),
    "u_coverage": lambda s, d: prep.coverage(s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("key")), s.read.parquet(f"{d}/documents.parquet").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("key"))),
    "j_backfill_printed": lambda s, d: prep.backfill_printed(_pages(s, d), _pages(s, d).where("pdf_page % 2 = 0").select("source_file", "pdf_page", F.concat(F.lit("x"), "pdf_page").alias("printed_page"))).select("source_file", "pdf_page", "printed_page"),
    "m_projection": lambda s, d: s.read.parquet(f"{d}/benchmark.parquet").select("item_id", prep.projected(F.col("text"), "[A-Za-z]").alias("p")).select("item_id", F.col("p.text").alias("text"), F.array_join(F.col("p.places").cast("array<string>"), ",").alias("places")),
    "p_offset_mode": lambda s, d: prep.page_offsets(_pages(s, d), 3),
    "w_monotone_filter": lambda s, d: prep.monotone_entries(_shuffled_contents(s, d)),
    "w_lis_repair": lambda s, d: prep.longest_non_decreasing(_shuffled_contents(s, d)),
    "w_interpolate": lambda s, d: prep.interpolated(_pages(s, d).select("source_file", F.col("pdf_page").alias("sort_order"), F.when(F.col("pdf_page") % 4 == 1, F.col("pdf_page") * 3).alias("known"))),
    "f_html_strip": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.sha2(feeds.strip_tags(F.col("html")), 256).alias("sha")),
    "f_titles": lambda s, d: feeds.page_titles(s.read.parquet(f"{d}/pages.parquet")),
    "f_anchor_extract": lambda s, d: feeds.anchors(s.read.parquet(f"{d}/pages.parquet")),
    "f_date_extract": lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", feeds.find_date(F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy/M/d"), F.lit("."))).alias("day")),
    "f_dedupe_key": lambda s, d: _articles(s, d).select("page_id", "dedupe_key"),
    "f_upsert_fold": f_upsert_fold,
    "f_undelivered": f_undelivered,
    "f_token_estimate": lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", feeds.token_estimate(F.col("text")).alias("tokens")),
    "w_last_turns": lambda s, d: feeds.last_turns(s.read.parquet(f"{d}/conversations.parquet")).select("conv_id", "turn", "role"),
    "l_suggest_rank": lambda s, d: lookup.suggest(_contents(s, d), "the"),
    "l_groups_by_letter": lambda s, d: lookup.groups_by_letter(_contents(s, d)),
    "l_stats": lambda s, d: lookup.stats(_contents(s, d)),
    "l_slugs": lambda s, d: lookup.slugs(_contents(s, d)),
    "a_label_coverage": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").join(s.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good")),
}

_STRIPPED = f"regexp_replace(title, '{_STRIP}', '', 'g')"
_ARTICLES = r"""
titled AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM pages),
articles AS (SELECT page_id, title, CASE WHEN page_id % 3 <> 0 AND trim(url) <> '' THEN 'url:' || lower(trim(url)) ELSE 'hash:' || sha256('j|' || title || '||') END AS dedupe_key FROM titled)"""
_FILLED = """
known AS (
  SELECT *, TRY_CAST(printed_page AS INT) AS number, CASE WHEN length(trim(raw_text)) > 0 THEN 1 ELSE 0 END AS has_text FROM corpus
), sides AS (
  SELECT *, last_value(CASE WHEN number IS NOT NULL THEN pdf_page END IGNORE NULLS) OVER b AS pa, last_value(number IGNORE NULLS) OVER b AS na,
         first_value(CASE WHEN number IS NOT NULL THEN pdf_page END IGNORE NULLS) OVER a AS pb, first_value(number IGNORE NULLS) OVER a AS nb
  FROM known WINDOW b AS (PARTITION BY source_file ORDER BY pdf_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY source_file ORDER BY pdf_page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
)"""

ORACLE_SQL: dict[str, str] = {
    "p_gap_fill": _with(_PAGES, _FILLED) + """SELECT source_file, pdf_page, CASE WHEN printed_page IS NOT NULL THEN printed_page WHEN nb - na = pb - pa THEN CAST(na + pdf_page - pa AS VARCHAR)
         WHEN has_text = 1 AND nb - na = (SELECT coalesce(sum(k.has_text), 0) FROM known k WHERE k.source_file = sides.source_file AND k.pdf_page > pa AND k.pdf_page < pb) + 1 AND nb - na > 1
         THEN CAST(na + (SELECT sum(k.has_text) FROM known k WHERE k.source_file = sides.source_file AND k.pdf_page > pa AND k.pdf_page <= sides.pdf_page) AS VARCHAR) END AS filled FROM sides""",
    "p_corrections": _with(_PAGES)
    + """, one AS (SELECT *, replace(raw_text, 'the ', 'THE ') AS t1 FROM pages),
         two AS (SELECT *, CASE WHEN volume = 3 THEN replace(t1, 'and', 'AND') ELSE t1 END AS t2 FROM one),
         three AS (SELECT *, (length(t2) - length(replace(t2, 'of', ''))) // 2 AS n3, (length(t2) - length(replace(t2, 'in', ''))) // 2 AS n4 FROM two)
         SELECT source_file, pdf_page, sha256(CASE WHEN volume = 1 AND pdf_page = 2 AND n3 = 1 THEN replace(t2, 'of', 'OF') WHEN volume = 2 AND pdf_page = 2 AND n4 = 99 THEN replace(t2, 'in', 'IN') ELSE t2 END) AS sha,
           CAST(contains(raw_text, 'the ') AS INT) + CAST(volume = 3 AND contains(t1, 'and') AS INT) + CAST(volume = 1 AND pdf_page = 2 AND n3 = 1 AS INT) + CAST(volume = 2 AND pdf_page = 2 AND n4 = 99 AS INT) AS applied,
           CAST(volume = 1 AND pdf_page = 2 AND n3 <> 1 AS INT) + CAST(volume = 2 AND pdf_page = 2 AND n4 <> 99 AS INT) AS ambiguous FROM three""",
    "p_bigrams": """SELECT bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(run)), lambda i: substr(run, CAST(i AS BIGINT), 2))) AS bigram
                    FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS run FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)) GROUP BY bigram""",
    "p_pair_tiers": _with(_PAGES)
    + """, pairs AS (SELECT substr(raw_text, i, 1) AS ocr, translate(substr(raw_text, i, 1), 'aeqx', 'eaou') AS auth FROM (SELECT raw_text, unnest(range(1, length(raw_text) + 1)) AS i FROM pages))
         SELECT ocr, auth, count(*) AS n, CASE WHEN count(*) >= 4 THEN 'high' WHEN count(*) >= 2 THEN 'mid' ELSE 'low' END AS tier FROM pairs WHERE ocr <> auth GROUP BY ALL""",
    "b_number_pages": _with(_PAGES)
    + """, found AS (SELECT source_file, pdf_page, CASE WHEN v >= 1 THEN v END AS v FROM (SELECT source_file, pdf_page, CASE WHEN pdf_page % 11 = 3 THEN pdf_page + 7 WHEN pdf_page % 4 <> 0 THEN pdf_page - CASE WHEN pdf_page > 10 THEN 2 ELSE 1 END END AS v FROM pages)),
         offs AS (SELECT source_file, pdf_page - v AS o, count(*) AS n FROM found WHERE v IS NOT NULL GROUP BY 1, 2),
         best AS (SELECT source_file, arg_max(o, (n, -o)) AS o, max(n) >= greatest(5, 0.6 * sum(n)) AS constant FROM offs GROUP BY source_file),
         anchors AS (SELECT f.*, CASE WHEN n >= 3 THEN f.pdf_page - v END AS t FROM found f LEFT JOIN offs ON offs.source_file = f.source_file AND offs.o = f.pdf_page - v),
         sides AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY pdf_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
                     first_value(t IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY pdf_page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM anchors)
         SELECT source_file, pdf_page, CASE WHEN coalesce(constant, false) THEN CASE WHEN pdf_page - o >= 1 THEN pdf_page - o END WHEN v IS NOT NULL THEN v
           WHEN (a IS NULL OR b IS NULL OR a = b) AND pdf_page - coalesce(a, b) >= 1 THEN pdf_page - coalesce(a, b) END AS number FROM sides LEFT JOIN best USING (source_file)""",
    "s_volume_names": with_inputs("""SELECT id, CASE id % 9 WHEN 0 THEN CASE WHEN id % 1200 BETWEEN 1 AND 999 THEN id % 1200 END WHEN 1 THEN nullif(id % 90, 0) WHEN 2 THEN nullif(id % 50, 0) WHEN 3 THEN nullif(id % 800, 0) WHEN 7 THEN nullif(id % 9, 0) WHEN 8 THEN 9 END AS volume FROM n""", n=NAMES),
    "l_volumes": _with(_PAGES) + "SELECT p.source_file, p.pages, coalesce(t.entries, 0) AS entries FROM (SELECT source_file, count(*) AS pages FROM corpus GROUP BY 1) p LEFT JOIN (SELECT source_file, count(*) AS entries FROM toc GROUP BY 1) t USING (source_file)",
    "l_volume_contents": _with(_PAGES) + "SELECT title, pdf_page, level FROM toc WHERE source_file = 'en/src0'",
    "u_coverage": """
      WITH live AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)
      SELECT 'stale' AS kind, doc_id AS key FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM live) UNION ALL
      SELECT 'missing', doc_id FROM (SELECT DISTINCT doc_id FROM live) WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'both', doc_id FROM (SELECT DISTINCT doc_id FROM live) WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "j_backfill_printed": _with(_PAGES) + "SELECT source_file, pdf_page, coalesce(printed_page, CASE WHEN pdf_page % 2 = 0 THEN 'x' || pdf_page END) AS printed_page FROM corpus",
    "m_projection": """
      SELECT item_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS text, array_to_string(list_filter(range(0, length(text)), lambda i: regexp_matches(substr(text, CAST(i + 1 AS BIGINT), 1), '[A-Za-z]')), ',') AS places FROM benchmark""",
    "p_offset_mode": _with(_PAGES)
    + """, offsets AS (SELECT source_file, TRY_CAST(printed_page AS INT) - pdf_page AS o, count(*) AS n FROM corpus WHERE TRY_CAST(printed_page AS INT) IS NOT NULL GROUP BY ALL)
         SELECT source_file, arg_max(o, (n, -o)) AS "offset", max(n) AS support, CAST(sum(n) AS BIGINT) AS pages, max(n) >= greatest(3, ceil(sum(n) * 0.6)) AS trusted FROM offsets GROUP BY source_file""",
    "w_monotone_filter": _with(_PAGES)
    + """SELECT source_file, sort_order, pdf_page FROM (SELECT source_file, (sort_order * 7) % 31 AS sort_order, pdf_page FROM toc)
         QUALIFY coalesce(pdf_page >= max(pdf_page) OVER (PARTITION BY source_file ORDER BY sort_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)""",
    "f_html_strip": r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS sha FROM pages",
    "f_titles": "WITH " + _ARTICLES.strip() + " SELECT page_id, title FROM titled",
    "f_anchor_extract": r"""
      WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>', 2) AS l FROM pages),
           rows_ AS (SELECT page_id, i - 1 AS n, h[i] AS href, trim(regexp_replace(regexp_replace(l[i], '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM a)),
           firsts AS (SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY n) = 1)
      SELECT page_id, n, href, label FROM firsts QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n) <= 25""",
    "f_date_extract": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    "f_dedupe_key": "WITH " + _ARTICLES.strip() + " SELECT page_id, dedupe_key FROM articles",
    "f_upsert_fold": "WITH "
    + _ARTICLES.strip()
    + """, current AS (SELECT dedupe_key, title, CASE WHEN page_id % 4 = 0 THEN 'archived' WHEN page_id % 4 = 1 THEN 'ignored' ELSE 'ready' END AS status FROM articles WHERE page_id % 2 = 0 OR page_id % 4 = 1),
           incoming AS (SELECT dedupe_key, title || '*' AS title FROM articles WHERE page_id % 5 <> 0),
           keys AS (SELECT dedupe_key FROM current UNION SELECT dedupe_key FROM incoming)
         SELECT k.dedupe_key, coalesce((SELECT max(title) FROM incoming i WHERE i.dedupe_key = k.dedupe_key), (SELECT max(title) FROM current c WHERE c.dedupe_key = k.dedupe_key)) AS title,
           CASE WHEN s IS NULL THEN 'pending' WHEN s = 'archived' AND u > 0 THEN 'restored' ELSE s END AS status, CASE WHEN u > 0 THEN 2 ELSE 1 END AS seen, u AS updates
         FROM (SELECT dedupe_key, (SELECT max(status) FROM current c WHERE c.dedupe_key = q.dedupe_key) AS s, (SELECT count(*) FROM incoming i WHERE i.dedupe_key = q.dedupe_key) AS u FROM keys q) k""",
    "f_undelivered": """
      WITH a AS (SELECT o_orderkey AS article_id, o_orderpriority AS topic, o_orderdate AS first_seen FROM orders),
           s AS (SELECT c_custkey AS subscription_id, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][c_nationkey % 5 + 1] AS topic FROM customer)
      SELECT subscription_id, count(*) AS articles, min(article_id) AS first FROM a JOIN s USING (topic) WHERE first_seen >= TIMESTAMP '1997-01-01'
        AND (article_id, subscription_id) NOT IN (SELECT (o_orderkey, o_custkey) FROM orders WHERE o_orderkey % 2 = 0) GROUP BY subscription_id""",
    "f_token_estimate": "SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE greatest(1, (length(text) + 1) // 2) END AS tokens FROM conversations",
    "w_last_turns": "SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6",
    "l_suggest_rank": _with(_PAGES)
    + f""", n AS (SELECT *, lower({_STRIPPED}) AS norm FROM toc)
          SELECT source_file, title, pdf_page, CASE WHEN norm = 'the' THEN 0 WHEN starts_with(norm, 'the') THEN 1 ELSE 2 END AS rank FROM n WHERE contains(norm, 'the')
          ORDER BY rank, length(norm), source_file, pdf_page, level, sort_order LIMIT 20""",
    "l_groups_by_letter": _with(_PAGES)
    + f""", n AS (SELECT *, upper(left({_STRIPPED}, 1)) AS f FROM toc)
          SELECT CASE WHEN f GLOB '[A-Z]' THEN f ELSE '#' END AS letter, count(*) AS entries, min(title) AS first_title, max(title) AS last_title FROM n GROUP BY 1""",
    "l_slugs": _with(_PAGES)
    + r""", n AS (SELECT source_file, sort_order, coalesce(nullif(trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g'), '-'), ''), 'entry') AS base FROM toc)
          SELECT source_file, sort_order, CASE WHEN r = 1 THEN base ELSE base || '-' || r END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY source_file, sort_order) AS r FROM n)""",
    "l_stats": _with(_PAGES) + "SELECT count(*) AS entries, count(DISTINCT source_file) AS files, count(*) FILTER (level = 1) AS top_level FROM toc",
    "a_label_coverage": "SELECT lang, count(*) AS documents, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "w_interpolate": _with(_PAGES)
    + """, k AS (SELECT source_file, pdf_page AS sort_order, CASE WHEN pdf_page % 4 = 1 THEN pdf_page * 3 END AS known FROM pages)
         SELECT source_file, sort_order, known, CASE WHEN sort_order - (sort_order - 1) % 4 + 4 <= max(sort_order) OVER (PARTITION BY source_file) OR known IS NOT NULL THEN sort_order * 3 END AS page FROM k""",
}
_SITES = with_inputs(
    """SELECT id, find, replace, d1 IS NOT NULL AND f3 >= f1 AND f4 >= f2 AND greatest(f3, f4) >= 3 AND f3 + f4 >= 3 * (f1 + f2 + 1) AS ok
       FROM (SELECT *, n(CASE WHEN d1 > 1 THEN substr(find, d1 - 1, 2) END) AS f1, n(CASE WHEN d2 < length(find) THEN substr(find, d2, 2) END) AS f2,
               n(CASE WHEN d1 > 1 THEN substr(replace, d1 - 1, 2) END) AS f3, n(CASE WHEN d2 < length(find) THEN substr(replace, d2, 2) END) AS f4
             FROM (SELECT *, list_min(d) AS d1, list_max(d) AS d2 FROM (SELECT *, list_filter(range(1, length(find) + 1), lambda i: substr(find, i, 1) <> substr(replace, i, 1)) AS d FROM sites)))""",
    sites=SITES,
    bi="""SELECT bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(run)), lambda i: substr(run, CAST(i AS BIGINT), 2))) AS bigram
          FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS run FROM {documents} WHERE lang IS NOT NULL AND source IS NOT NULL)) GROUP BY bigram""",
)
for _call in ("CASE WHEN d1 > 1 THEN substr(find, d1 - 1, 2) END", "CASE WHEN d2 < length(find) THEN substr(find, d2, 2) END", "CASE WHEN d1 > 1 THEN substr(replace, d1 - 1, 2) END", "CASE WHEN d2 < length(find) THEN substr(replace, d2, 2) END"):
    _SITES = _SITES.replace(f"n({_call})", f"coalesce((SELECT n FROM bi WHERE bigram = {_call}), 0)")
ORACLE_SQL["p_validate_sites"] = _SITES
ORACLE_SQL["p_tier_crosstab"] = f"SELECT length(find) AS length, ok, count(*) AS n FROM ({_SITES}) GROUP BY ALL"
