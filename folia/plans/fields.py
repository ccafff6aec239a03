"""Queries of the functions on contents, feeds and requests, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions import fields as f
from folia.operators import guard, journal
from folia.plans.shared import rows, with_inputs

LINES = """
SELECT p_partkey AS id, CASE p_partkey % 10
  WHEN 0 THEN p_name || ' .... ' || CAST(p_partkey % 400 + 1 AS STRING)
  WHEN 1 THEN p_name || '  ' || CAST(p_partkey % 90 + 1 AS STRING) || ' – ' || CAST(p_partkey % 90 + 9 AS STRING)
  WHEN 2 THEN p_name || '…' || CAST(p_partkey AS STRING)
  WHEN 3 THEN p_name
  WHEN 4 THEN 'xiv'
  WHEN 5 THEN '  ' || p_name || '   xii'
  WHEN 6 THEN '目 录'
  WHEN 7 THEN '马克思 ' || p_brand
  WHEN 8 THEN p_name || ' (' || p_type || ') ····· ' || CAST(p_partkey % 50 + 1 AS STRING) || '—' || CAST(p_partkey % 50 + 4 AS STRING)
  ELSE '12' || p_name END AS line,
  CASE p_partkey % 5 WHEN 0 THEN '— ' || CAST(p_partkey AS STRING) || ' —' WHEN 1 THEN '[' || CAST(p_partkey AS STRING) || ']' WHEN 2 THEN ' xIv ' WHEN 3 THEN p_name ELSE CAST(p_partkey * 7 AS STRING) END AS mark
FROM {part}"""


def f_contents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = rows(spark, sf_dir, LINES).withColumn("c", f.contents_line(F.col("line")))
    title = F.col("c.title")
    return parsed.select(
        "id", title.alias("title"), F.col("c.page").alias("page"), f.page_token(F.col("mark")).alias("token"), f.is_navigable(title).alias("navigable"), f.is_noise(title).alias("noise"),
        f.carries_on(title).alias("carries"), f.without_date(title).alias("undated"), f.without_number(title).alias("unnumbered"), f.dictionary_norm(F.col("line")).alias("norm"),
    )


FEED = """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Li Wei[1], Ann[2]；Bo' WHEN 1 THEN 'A;B、C  D' WHEN 2 THEN '[1]' ELSE o_orderpriority END AS authors,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey % 70 AS STRING) END AS first, CASE WHEN o_orderkey % 2 = 0 THEN ' ' || CAST(o_orderkey % 35 AS STRING) END AS last,
  CASE o_orderkey % 7 WHEN 0 THEN '2001-2-3' WHEN 1 THEN '1999-11' WHEN 2 THEN '2003' WHEN 3 THEN '' WHEN 4 THEN '1998-01-01' WHEN 5 THEN '1998-13-40' ELSE 'spring' END AS published,
  CASE o_orderkey % 2 WHEN 0 THEN 'x1' ELSE '' END AS source_id,
  CASE o_orderkey % 5 WHEN 0 THEN '7:05' WHEN 1 THEN '29:75' WHEN 2 THEN 'noon' WHEN 3 THEN '' ELSE ' 12:00 ' END AS clock,
  CASE o_orderkey % 4 WHEN 0 THEN 'YES ' WHEN 1 THEN 'off' WHEN 2 THEN '是' ELSE o_orderstatus END AS word, o_orderdate AS day
FROM {orders}"""


def f_feed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, none = F.col("day"), F.array().cast("array<int>")
    parts = F.when(F.col("id") % 3 == 0, none).when(F.col("id") % 3 == 1, F.array(F.year(day))).otherwise(F.array(F.year(day), F.month(day)))
    return rows(spark, sf_dir, FEED).select(
        "id", F.array_join(f.split_authors(F.col("authors")), "|").alias("authors"), f.page_range(F.col("first"), F.col("last")).alias("pages"),
        f.iso_date(parts, F.when(F.col("id") % 2 == 0, F.array(F.year(day), F.month(day), F.dayofmonth(day)))).alias("day"),
        f.latest_possible(F.col("published")).cast("string").alias("bound"), f.is_placeholder_date(F.col("published"), F.col("source_id")).alias("placeholder"),
        f.clock(F.col("clock")).alias("clock"), f.boolean_word(F.col("word")).alias("yes"), f.author_name(F.col("first"), F.col("last")).alias("name"),
    )


TALK = """
SELECT conv_id, turn, text, replace(text, '.', '。') AS stopped, CASE turn % 3 WHEN 0 THEN ' ' WHEN 1 THEN substr(text, 1, 50) ELSE substr(text, 5, 9) END AS query,
  CASE turn % 4 WHEN 0 THEN 'a [[H]] ' || substr(text, 1, 200) || '[[/H]] b [[H]]c[[/H]]' WHEN 1 THEN '[[H]] [[/H]]' ELSE text END AS context,
  CASE turn % 4 WHEN 0 THEN 'Sure: ```json' || chr(10) || '{"n": 1, "a": [2]}' || chr(10) || '``` done' WHEN 1 THEN 'so {"b": {"c": "}"}} and {"d": 1}' WHEN 2 THEN 'broken {"a": ' ELSE '["x", 1]' END AS answer,
  CASE turn % 3 WHEN 0 THEN '<think>a b</think>' || text WHEN 1 THEN '<think>open' || chr(10) || chr(10) || 'rest' ELSE text END AS thought,
  CASE turn % 3 WHEN 0 THEN '["a","b"]' WHEN 1 THEN 'nothing' END AS list
FROM {conversations}"""


def f_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return rows(spark, sf_dir, TALK).select(
        "conv_id", "turn", f.excerpt(text, 60).alias("short"), f.sentence_excerpt(F.col("stopped"), 120).alias("sentence"), F.array_join(f.highlight_terms(F.col("query")), "|").alias("terms"),
        f.marked(F.col("context"), F.lit("none")).alias("marked"), F.array_join(f.gist_terms(F.col("query")), "|").alias("gist"), f.json_in(F.col("answer")).alias("json"), f.brace_slice(F.col("answer")).alias("braces"),
        f.without_thinking(F.col("thought")).alias("spoken"), F.size(f.json_strings(F.col("list"))).alias("listed"), F.size(f.paragraphs(F.replace(text, F.lit(". "), F.lit("\n \n")))).alias("paragraphs"),
        F.array_join(f.unique_keywords(F.split(F.col("query"), " ")), "|").alias("keywords"), f.clean_title(text).alias("title"),
    )


TITLES = """
SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'Editorial Board of ' || p_name WHEN 1 THEN '目录' WHEN 2 THEN '2003年 第3期' WHEN 3 THEN 'abc' WHEN 4 THEN p_name || '论文通知'
  WHEN 5 THEN p_name || ' ' || p_type || '的通知与研究方法再考察' WHEN 6 THEN '封面人物访谈录' WHEN 7 THEN NULL ELSE p_name END AS title,
  CASE p_partkey % 3 WHEN 0 THEN ' Article ' WHEN 1 THEN '' ELSE p_type END AS kind FROM {part}"""
_T = "trim(title)"
_ZH = " OR ".join(f"(contains({_T}, '{p}') AND (length({_T}) <= 16 OR starts_with({_T}, '{p}') OR ends_with({_T}, '{p}')))" for p in journal.NO_ARTICLE_PARTS_ZH)
_EN = " OR ".join(f"contains(lower({_T}), '{p}')" for p in journal.NO_ARTICLE_PARTS_EN)

REQUESTS = """
SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN user_id END AS user_id, CASE event_id % 4 WHEN 0 THEN '8.8.4.' || CAST(event_id % 200 AS STRING) WHEN 1 THEN '192.168.1.5' WHEN 2 THEN ' ' ELSE 'unknown' END AS ip,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 's' || CAST(user_id AS STRING) END AS session, CASE event_id % 6 WHEN 0 THEN 'Mozilla/5.0' WHEN 1 THEN 'CURL/8.1' WHEN 2 THEN '' WHEN 3 THEN 'x GPTBot/1' WHEN 4 THEN 'probe-7 Mozilla' END AS agent,
  CASE event_id % 8 WHEN 0 THEN 'api_search' WHEN 1 THEN 'library' WHEN 2 THEN 'api_ai_chat' WHEN 3 THEN 'pricing' WHEN 4 THEN 'static' WHEN 5 THEN 'home' WHEN 6 THEN 'pricing' END AS endpoint,
  CASE WHEN event_id % 8 = 6 THEN ' journal' END AS origin, CASE event_id % 3 WHEN 0 THEN '1.1.1.1, 10.0.0.1 , 9.9.9.9,' WHEN 1 THEN ' , ' END AS forwarded, CASE WHEN event_id % 2 = 0 THEN '127.0.0.1' END AS remote,
  CASE event_id % 10 WHEN 0 THEN ' Ops@Example.org' ELSE 'u@example.org' END AS address
FROM {events}"""


def g_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    exempt = guard.is_exempt(F.col("user_id"), F.col("address"), F.col("agent"), F.col("ip"), ("ops@example.org",), ("42",), ("probe-7",), ("8.8.4.8",))
    return rows(spark, sf_dir, REQUESTS).select(
        "id", f.actor_key(F.col("user_id"), F.col("ip"), F.col("session")).alias("actor"), f.client_ip(F.col("forwarded"), F.col("remote")).alias("client"), f.feature_of(F.col("endpoint"), F.col("origin")).alias("feature"),
        guard.is_blocked_agent(F.col("agent")).alias("blocked"), exempt.alias("exempt"), f.is_public_ip(F.col("ip")).alias("public"), f.masked(F.col("session")).alias("masked"), f.email(F.col("address")).alias("email"),
    )


PAIRS = "SELECT p_partkey AS id, p_name AS a, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS b FROM {part}"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "f_contents_lines": f_contents_lines,
    "f_feed_fields": f_feed_fields,
    "f_excerpts": f_excerpts,
    "f_article_titles": lambda s, d: rows(s, d, TITLES).select("id", journal.is_article_title(F.col("title")).alias("article"), journal.is_allowed_type(F.col("kind"), ("article", "economy")).alias("allowed")),
    "f_meta_description": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", f.meta_description(F.replace("html", F.lit("<title>"), F.lit('<meta name="description" content=" About "><title>'))).alias("description")),
    "g_requests": g_requests,
    "f_ratio": lambda s, d: rows(s, d, PAIRS).select("id", f.ratio(F.col("a"), F.col("b")).alias("ratio")),
}

_SIGNS, _DOTS, _RANGE = r"[IVXLCDMivxlcdm\d]+", r"[·•∙⋯…\.\s]", r"[-—–~～至]+"
_FORMS = (
    rf"^(.+?)(?:{_DOTS}{{2,}}|[·•∙⋯…\.]+\s*)({_SIGNS})(?:\s*{_RANGE}\s*({_SIGNS}))?\s*$",
    rf"^(.+?)\s+({_SIGNS})\s*{_RANGE}\s*({_SIGNS})\s*$",
    rf"^(.+?)\s+({_SIGNS})\s*$",
)
_B, _E = r"^\s*[\[\(（【<〈『「\-—–·\.]*\s*", r"\s*[\]\)）】>〉』」\-—–·\.]*\s*$"


def _token(x: str) -> str:
    number, roman = f"regexp_extract({x}, '{_B}(\\d{{1,4}}){_E}', 1)", f"regexp_extract({x}, '(?i){_B}([ivxlcdm]{{1,10}}){_E}', 1)"
    return f"CASE WHEN TRY_CAST({number} AS INT) BETWEEN 1 AND 3000 THEN CAST(CAST({number} AS INT) AS VARCHAR) WHEN {roman} <> '' THEN 'pre-' || lower({roman}) END"


_CASES = " ".join(
    f"WHEN trim(regexp_extract(clean, '{p}', 1)) <> '' AND {_token(f'''regexp_extract(clean, '{p}', 2)''')} IS NOT NULL THEN {{'title': trim(regexp_extract(clean, '{p}', 1)), 'page': {_token(f'''regexp_extract(clean, '{p}', 2)''')}}}"
    for p in _FORMS
)
_NUMERIC = r"regexp_full_match(title, '[0-9IVXLCDMivxlcdm\s\-—–\.]+')"
_STOPS = " ".join(f"WHEN contains(head, '{s}') AND length(head) - instr(reverse(head), '{s}') >= 40 THEN left(head, length(head) - instr(reverse(head), '{s}') + 1)" for s in "。！？；…")
_COLLAPSED = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_STRIPPED = r"""regexp_replace(w, '[\s\x1c-\x1f\x{2000}-\x{206f}\x{2e00}-\x{2e7f}\x{3000}-\x{303f}\x{ff00}-\x{ffef}!-/:-@\[-`{-~]+', '', 'g')"""

ORACLE_SQL: dict[str, str] = {
    "f_contents_lines": with_inputs(
        rf"""SELECT id, title, page, token, title <> '' AND NOT {_NUMERIC} AS navigable, replace(title, ' ', '') = '目录' OR {_NUMERIC} AS noise,
          NOT (replace(title, ' ', '') = '目录' OR {_NUMERIC}) AND NOT (starts_with(title, '马克思') AND length(title) <= 24) AND length(title) > 2 AS carries,
          trim(regexp_replace(title, '[（(][^）)]*[）)]\s*$', '')) AS undated, regexp_replace(title, '^(?:[一二三四五六七八九十百零〇]+|[0-9]+)', '') AS unnumbered, norm
        FROM (SELECT id, {_token('trim(mark)')} AS token, unnest(CASE {_CASES} ELSE {{'title': clean, 'page': NULL}} END), lower({_STRIPPED.replace('(w,', '(line,')}) AS norm
              FROM (SELECT *, trim(regexp_replace(translate(replace(line, '…', '...'), '—–', '--'), '\s+', ' ', 'g')) AS clean FROM lines))""",
        lines=LINES,
    ),
    "f_feed_fields": with_inputs(
        r"""SELECT id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(authors, '\[[^\]]*\]', '', 'g'), '[;,，、\s]+'), lambda a: a <> ''), '|') AS authors,
          CASE WHEN first <> '' AND last IS NOT NULL AND first <> trim(last) THEN first || '-' || trim(last) WHEN first <> '' THEN first ELSE coalesce(trim(last), '') END AS pages,
          CASE WHEN id % 3 = 1 THEN strftime(day, '%Y-01-01') WHEN id % 3 = 2 THEN strftime(day, '%Y-%m-01') WHEN id % 2 = 0 THEN strftime(day, '%Y-%m-%d') ELSE '' END AS day,
          CASE published WHEN '2001-2-3' THEN '2001-02-03' WHEN '1999-11' THEN '1999-11-28' WHEN '1998-01-01' THEN '1998-01-01' END AS bound,
          published IN ('', '2003') OR published = '1998-01-01' AND source_id <> '' AS placeholder,
          CASE clock WHEN '7:05' THEN '07:05' WHEN '29:75' THEN '23:59' WHEN ' 12:00 ' THEN '12:00' ELSE '08:00' END AS clock, trim(lower(word)) <> 'off' AS yes,
          trim(first || ' ' || coalesce(trim(last), '')) AS name FROM feed""",
        feed=FEED,
    ),
    "f_excerpts": with_inputs(
        rf"""SELECT conv_id, turn, CASE WHEN length(own) > 60 THEN rtrim(left(own, 60)) || '…' ELSE own END AS short,
          CASE WHEN length(stop) <= 120 THEN stop ELSE CASE {_STOPS} ELSE head || '……' END END AS sentence,
          CASE WHEN q = '' THEN '' ELSE array_to_string(list_filter(cand, lambda x, i: list_position(cand, x) = i), '|') END AS terms,
          CASE WHEN mark <> '' THEN left(mark, 160) ELSE 'none' END AS marked, array_to_string(list_filter(gists, lambda x, i: list_position(gists, x) = i)[1:8], '|') AS gist,
          CASE turn % 4 WHEN 0 THEN '{{"a":[2],"n":1}}' WHEN 1 THEN '{{"b":{{"c":"}}"}}}}' WHEN 2 THEN '{{}}' ELSE '["x",1]' END AS json,
          nullif(regexp_extract(answer, '(?s)(\{{.*\}})', 1), '') AS braces, CASE turn % 3 WHEN 1 THEN 'rest' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS spoken,
          CASE WHEN turn % 3 = 0 THEN 2 ELSE 0 END AS listed, len(list_filter(string_split(text, '. '), lambda x: trim(x, ' ') <> '')) AS paragraphs,
          array_to_string(list_filter(keys, lambda x, i: list_position(keys, x) = i)[1:8], '|') AS keywords, own AS title
        FROM (SELECT *, left(stop, 120) AS head, list_concat(CASE WHEN replace(q, ' ', '') <> q AND length(replace(q, ' ', '')) >= 4 THEN [q, replace(q, ' ', '')] ELSE [q] END,
                list_transform(list_sort(list_transform(toks, lambda t, i: {{'n': -length(t), 'i': i, 't': t}})), lambda x: x.t)[1:8]) AS cand
              FROM (SELECT *, {_COLLAPSED} AS own, {_COLLAPSED.replace('text', 'stopped')} AS stop, {_COLLAPSED.replace('text', 'query')} AS q,
                      list_filter(regexp_split_to_array({_COLLAPSED.replace('text', 'query')}, '[\s，。；：、“”‘’？,.!?;:()（）【】《》]+'), lambda t: length(t) >= 2) AS toks,
                      trim(regexp_replace(regexp_extract(context, '(?s)\[\[H\]\](.*?)\[\[/H\]\]', 1), '\s+', ' ', 'g')) AS mark,
                      list_filter(regexp_split_to_array(query, '[\s,，、;；:：/|·\-—　]+'), lambda w: length({_STRIPPED}) >= 2) AS gists,
                      list_filter(list_transform(string_split(query, ' '), lambda w: {_STRIPPED}), lambda w: length(w) >= 2) AS keys FROM talk))""",
        talk=TALK,
    ),
    "f_article_titles": with_inputs(
        rf"""SELECT id, coalesce(length(title) BETWEEN 4 AND 160 AND NOT list_contains({list(journal.NO_ARTICLE)}, {_T}) AND NOT ({_EN}) AND NOT ({_ZH})
               AND NOT regexp_full_match({_T}, '[第\d\s年卷期页\-—~、.,()（）]+') AND regexp_matches(title, '[一-鿿A-Za-z]'), false) AS article,
             trim(kind) = '' OR lower(trim(kind)) IN ('article', 'economy') AS allowed FROM titles""",
        titles=TITLES,
    ),
    "f_meta_description": "SELECT page_id, CASE WHEN contains(html, '<title>') THEN 'About' ELSE '' END AS description FROM pages",
    "g_requests": with_inputs(
        rf"""SELECT id, CASE WHEN user_id <> 0 THEN 'user:' || user_id WHEN trim(ip) <> '' THEN 'ip:' || trim(ip) WHEN session <> '' THEN 'session:' || session ELSE 'session:anonymous' END AS actor,
          CASE WHEN id % 3 = 0 THEN '9.9.9.9' ELSE coalesce(remote, 'unknown') END AS client,
          CASE endpoint WHEN 'api_search' THEN 'search' WHEN 'library' THEN 'reader' WHEN 'api_ai_chat' THEN 'ai' WHEN 'pricing' THEN CASE WHEN origin IS NULL THEN 'pricing' ELSE 'pricing_journal' END WHEN 'home' THEN 'site' END AS feature,
          coalesce(agent, '') = '' OR {" OR ".join(f"contains(lower(agent), '{t}')" for t in guard.BLOCKED_AGENTS)} AS blocked,
          id % 10 = 0 OR coalesce(user_id = 42, false) OR coalesce(agent = 'probe-7 Mozilla', false) OR ip = '8.8.4.8' AS exempt, starts_with(ip, '8.8.') AS public, sha256(session) AS masked, lower(trim(address)) AS email FROM requests""",
        requests=REQUESTS,
    ),
    "f_ratio": with_inputs("SELECT id, CASE WHEN id % 2 = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (length(a) - length(replace(a, ' ', ''))) / (2 * length(a)) END AS ratio FROM pairs", pairs=PAIRS),
}
