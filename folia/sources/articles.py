"""Articles of sources, from saved responses: candidates in order, a form for each type, the first candidate that serves.

Sources have source, source_type, source_url, issn, name, language and config (JSON text); responses have url and body,
which is null where nothing came. Nothing is fetched here: a crawler, or a stream of files, writes responses.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from folia.functions.fields import author_name, given, iso_date, page_range, split_authors
from folia.functions.text import trimmed
from folia.operators.feeds import find_date, inverted_text, strip_tags, unescape
from folia.operators.journal import is_allowed_type, is_article_title
from folia.sources.readers import ITEMS

# Types of sources, keys of their configurations, names of the parser of journal pages, types of works.
FEED, WEB, WORKS, ITEMS_API = "rss", "web_html", "openalex", "crossref"
CONFIG = "entry_url string, fallback_urls array<string>, parser string, gch string, link_selector string, auto_publish boolean"
JOURNAL_PAGES = "ncpssd_journal"
WORK_TYPES = {WORKS: ("article", "journal-article", "review"), ITEMS_API: ("journal-article",)}
#: Articles of a source whose missing abstract is looked up.
LOOKUPS = 15
#: Characters about a link that are searched for its date, and after a journal page's record for what belongs to it.
BEFORE, AFTER, RECORD = 240, 360, 600
#: Links, at least as long as this, that hold all that is searched before the next one.
MATCHES = -(-BEFORE // len("<a></a>"))

_ITEM = "title: string, link: array<struct<_VALUE: string, _href: string>>, description: string, summary: string, content: string, pubDate: string, published: string, updated: string"
_FEED = f"channel struct<item: array<struct<{_ITEM}>>>, item array<struct<{_ITEM}>>, entry array<struct<{_ITEM}>>, _broken string"
_WORKS = """results array<struct<id: string, doi: string, title: string, type: string, publication_date: string,
  abstract_inverted_index: map<string, array<int>>, authorships: array<struct<author: struct<display_name: string>>>,
  primary_location: struct<landing_page_url: string, source: struct<display_name: string>>,
  biblio: struct<volume: string, issue: string, first_page: string, last_page: string>>>, _broken string"""
_DATE = "struct<`date-parts`: array<array<int>>>"
_ITEMS = f"""message struct<items: array<struct<title: array<string>, `container-title`: array<string>, type: string, abstract: string, DOI: string, URL: string,
  volume: string, issue: string, page: string, author: array<struct<family: string, given: string>>,
  `published-print`: {_DATE}, `published-online`: {_DATE}, published: {_DATE}, created: {_DATE}>>>, _broken string"""


@F.pandas_udf(ArrayType(StringType()))
def resolved(bases: pd.Series, links: pd.Series) -> pd.Series:
    """Links as seen from a base; one that can't be read stays as it is."""

    def one(base: str, link: str) -> str:
        try:
            return urljoin(base or "", link)
        except ValueError:
            return link

    return pd.Series([None if own is None else [None if x is None else one(base, x) for x in own] for base, own in zip(bases, links, strict=True)])


def _each_unescaped(texts: Column) -> Column:
    # no text holds the separator, as XML and HTML forbid it; one that does would only be cut
    clean = F.transform(texts, lambda t: F.replace(F.coalesce(t, F.lit("")), F.lit("\0"), F.lit(" ")))
    return F.when(F.size(texts) == 0, F.slice(texts, 1, 0)).otherwise(F.split(unescape(F.array_join(clean, "\0")), "\0"))


def candidates(sources: DataFrame, journal_base: str = "") -> DataFrame:
    """source, n and url of each response that a source may come from, best first, each once.

    Feeds and web pages: the entry url, the source's own, fallbacks. A journal page with a number of its journal takes
    the page of that number under ``journal_base`` first, unless it is listed. The two services of works are asked by
    issn and named like ``openalex:1234-5678``. Other types, and sources without any, give no row.
    """
    config = F.from_json(F.coalesce("config", F.lit("{}")), CONFIG)
    rows = sources.withColumn("__c", config).withColumn("__t", F.lower(trimmed(F.coalesce("source_type", F.lit("")))))
    listed = F.concat(F.array("__c.entry_url", "source_url"), F.coalesce("__c.fallback_urls", F.array().cast("array<string>")))
    listed = F.array_distinct(F.filter(F.transform(listed, given), lambda u: u.isNotNull()))
    page = F.when((F.lower(trimmed("__c.parser")) == JOURNAL_PAGES) & (F.lit(journal_base) != ""), F.concat(F.lit(f"{journal_base}?gch="), given(F.col("__c.gch"))))
    first = F.when(page.isNotNull() & ~F.array_contains(listed, F.coalesce(page, F.lit(""))), F.array(page)).otherwise(F.array().cast("array<string>"))
    listed = F.when(F.col("__t") == WEB, F.concat(first, listed)).otherwise(listed)
    asked = F.filter(F.array(F.concat("__t", F.lit(":"), given(F.col("issn")))), lambda u: u.isNotNull())
    urls = F.when(F.col("__t").isin(FEED, WEB), listed).when(F.col("__t").isin(WORKS, ITEMS_API), asked)
    return rows.select("source", F.posexplode(urls).alias("n", "url"))


def _article(**values: Column) -> Column:
    text = lambda name: F.coalesce(values.get(name, F.lit("")), F.lit(""))
    return F.struct(
        *[text(c).alias(c) for c in ("title", "url", "published_at", "abstract", "doi", "volume", "issue", "pages", "journal")],
        F.coalesce(values.get("authors", F.array().cast("array<string>")), F.array().cast("array<string>")).alias("authors"),
    )


def _first_distinct(items: Column, key: Callable[[Column], Column], most: int | None) -> Column:
    """The first items that differ in a key: with ``most`` no step looks at more than these, else keys are sorted, so that many items take no squares."""
    if most is not None:
        held = lambda had, x: (F.size(had) >= most) | F.exists(had, lambda y: key(y) == key(x))
        return F.aggregate(items, F.slice(items, 1, 0), lambda had, x: F.when(held(had, x), had).otherwise(F.concat(had, F.array(x))))
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(keyed, lambda y: y["k"]))
    firsts = F.zip_with(keyed, before, lambda y, k: F.when(y["i"].isNotNull() & ~y["k"].eqNullSafe(k), F.struct(y["i"].alias("i"), y["x"].alias("x"))))
    return F.transform(F.sort_array(F.filter(firsts, lambda y: y.isNotNull())), lambda y: y["x"])


def _of_feeds(rows: DataFrame, most: int | None) -> DataFrame:
    xml = F.from_xml("body", _FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = rows.withColumn("__x", xml).withColumn("__ok", F.col("__x").isNotNull() & F.col("__x._broken").isNull())
    items = F.concat(*[F.coalesce(x, F.slice("__x.entry", 1, 0), F.from_json(F.lit("[]"), f"array<struct<{_ITEM}>>")) for x in ("__x.channel.item", "__x.item")])
    items = F.when(F.size(items) > 0, items).otherwise(F.coalesce("__x.entry", items))
    rows = rows.withColumn("__i", F.filter(items if most is None else F.slice(items, 1, most), lambda x: x["title"] != ""))
    some = lambda x, *names: F.coalesce(*[F.nullif(x[c], F.lit("")) for c in names], F.lit(""))
    link = lambda x: F.coalesce(F.nullif(F.get(x["link"], F.lit(0))["_VALUE"], F.lit("")), F.get(x["link"], F.lit(0))["_href"], F.lit(""))
    rows = rows.withColumn("__u", resolved("url", F.transform("__i", lambda x: trimmed(link(x)))))
    rows = rows.withColumn("__t", _each_unescaped(F.transform("__i", lambda x: trimmed(x["title"]))))
    rows = rows.withColumn("__s", _each_unescaped(F.transform("__i", lambda x: trimmed(some(x, "description", "summary", "content")))))
    day = lambda x: trimmed(some(x, "pubDate", "published", "updated"))
    made = lambda x: _article(title=x["__t"], url=x["__u"], published_at=day(x["__i"]), abstract=strip_tags(x["__s"]), journal=F.col("name"))
    # zipped, as a text taken from its array item by item may be made anew for each; a feed that can be read serves, even if it is empty
    return rows.withColumn("articles", F.transform(F.arrays_zip("__i", "__t", "__s", "__u"), made)).withColumn("serves", F.col("__ok"))


def _matches(pattern: str, **groups: int) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all("body", F.lit(pattern), F.lit(i)).alias(name) for name, i in groups.items()])


def _of_lists(rows: DataFrame, most: int | None) -> DataFrame:
    """Links of list pages whose label can be an article's title and whose target holds the selector, with dates about them."""
    # each match begins where the one before ends, so what stands before a link is told by matches, without looking back in the text
    pattern = rf"(?is)\G(.*?)<a\b([^>]*)>(.*?)</a>(?=(.{{0,{AFTER}}}))"
    rows = rows.withColumn("__i", _matches(pattern, whole=0, gap=1, attrs=2, label=3, after=4))
    rows = rows.withColumn("__e", F.transform("__i", lambda x: F.right(x["whole"], F.lit(BEFORE))))
    ended = lambda i: F.array_join(F.slice("__e", F.greatest(i - MATCHES, F.lit(0)) + 1, F.least(i, F.lit(MATCHES))), "")
    rows = rows.withColumn("__i", F.transform("__i", lambda x, i: x.withField("before", F.right(F.concat(ended(i), x["gap"]), F.lit(BEFORE)))))
    href = lambda x: F.regexp_extract(x["attrs"], r"""(?i)href\s*=\s*["']([^"']+)["']""", 1)
    rows = rows.withColumn("__i", F.filter("__i", lambda x: href(x) != ""))
    rows = rows.withColumn("__h", F.transform(_each_unescaped(F.transform("__i", href)), trimmed))
    rows = rows.withColumn("__t", F.transform(_each_unescaped(F.transform("__i", lambda x: strip_tags(x["label"]))), trimmed)).withColumn("__u", resolved("url", "__h"))
    near = lambda x: F.concat(x["before"], x["attrs"], F.lit(">"), x["label"], x["after"])
    made = lambda x, i: F.struct(F.get("__h", i).alias("href"), F.get("__t", i).alias("title"), F.get("__u", i).alias("url"), near(x).alias("near"))
    fits = lambda x: is_article_title(x["title"]) & F.contains(x["href"], F.coalesce(given(F.col("__c.link_selector")), F.lit("")))
    kept = _first_distinct(F.filter(F.transform("__i", made), fits), lambda x: x["url"], most)
    # only links that are kept are searched for dates
    articles = F.transform(kept, lambda x: _article(title=x["title"], url=x["url"], published_at=find_date(x["near"]), journal=F.col("name")))
    return rows.withColumn("articles", articles).withColumn("serves", F.size("articles") > 0)


def _of_journal_pages(rows: DataFrame, most: int | None) -> DataFrame:
    """Records of journal pages; the year and issue stand in an article's number, authors and pages after its record."""
    pattern = rf"(?s)openDetail\('(/Literature/articleinfo\?id=([A-Za-z0-9]+)[^']*)'\).*?title='([^']*)'(?=(.{{0,{RECORD}}}))"
    rows = rows.withColumn("__i", _matches(pattern, href=1, id=2, title=3, after=4))
    writer = lambda x: F.regexp_extract(x["after"], r"""class=['"]writer['"][^>]*>([^<]*)<""", 1)
    rows = rows.withColumn("__t", F.transform(_each_unescaped(F.transform("__i", lambda x: strip_tags(x["title"]))), trimmed)).withColumn("__w", _each_unescaped(F.transform("__i", writer)))
    rows = rows.withColumn("__u", resolved("url", _each_unescaped(F.transform("__i", lambda x: x["href"]))))
    dated = r"((?:19|20)\d{2})(\d{3})\d{3}$"
    year, issue = (lambda x: F.nullif(F.regexp_extract(x["id"], dated, 1), F.lit(""))), (lambda x: F.regexp_extract(x["id"], dated, 2))
    pages = lambda x: trimmed(F.regexp_extract(x["after"], r"""class=['"]pages['"][^>]*>\(?([^<)]*)""", 1))
    made = lambda x, i: F.struct(
        x["id"].alias("id"),
        _article(
            title=F.get("__t", i), url=F.get("__u", i), published_at=F.concat(year(x), F.lit("-01-01")), issue=issue(x).try_cast("int").cast("string"),
            authors=split_authors(strip_tags(F.get("__w", i))), pages=pages(x), journal=F.col("name"),
        ).alias("a"),
    )
    kept = _first_distinct(F.filter(F.transform("__i", made), lambda x: is_article_title(x["a"]["title"])), lambda x: x["id"], most)
    return rows.withColumn("articles", F.transform(kept, lambda x: x["a"])).withColumn("serves", F.size("articles") > 0)


def _json(schema: str) -> Column:
    return F.from_json("body", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})


def _answered(rows: DataFrame, items: str, made: Callable[[Column], Column], kinds: tuple[str, ...], most: int | None) -> DataFrame:
    ok = F.col("__x").isNotNull() & F.col("__x._broken").isNull()
    kept = F.filter(items, lambda x: x.isNotNull() & is_allowed_type(x["type"], kinds))
    articles = F.filter(F.transform(kept, made), lambda a: is_article_title(a["title"]))
    return rows.withColumn("articles", articles if most is None else F.slice(articles, 1, most)).withColumn("serves", ok)


def _of_works(rows: DataFrame, most: int | None) -> DataFrame:
    def made(x: Column) -> Column:
        place, bib = x["primary_location"], x["biblio"]
        names = F.transform(x["authorships"], lambda a: given(a["author"]["display_name"]))
        return _article(
            title=trimmed(x["title"]), url=F.coalesce(given(place["landing_page_url"]), trimmed(x["id"])), published_at=trimmed(x["publication_date"]),
            abstract=inverted_text(x["abstract_inverted_index"]), doi=F.regexp_replace(trimmed(x["doi"]), "(?i)^https://doi.org/", ""),
            volume=trimmed(bib["volume"]), issue=trimmed(bib["issue"]), pages=page_range(bib["first_page"], bib["last_page"]),
            journal=F.coalesce(given(place["source"]["display_name"]), F.col("name")), authors=F.filter(names, lambda n: n.isNotNull()),
        )

    return _answered(rows.withColumn("__x", _json(_WORKS)), "__x.results", made, WORK_TYPES[WORKS], most)


def _of_items(rows: DataFrame, most: int | None) -> DataFrame:
    def made(x: Column) -> Column:
        day = iso_date(*[F.get(x[c]["date-parts"], F.lit(0)) for c in ("published-print", "published-online", "published", "created")])
        return _article(
            title=trimmed(F.array_join(x["title"], " ")), url=trimmed(x["URL"]), published_at=day, abstract=strip_tags(x["abstract"]), doi=trimmed(x["DOI"]),
            volume=trimmed(x["volume"]), issue=trimmed(x["issue"]), pages=trimmed(x["page"]), journal=F.coalesce(given(F.array_join(x["container-title"], " ")), F.col("name")),
            authors=F.filter(F.transform(x["author"], lambda a: given(author_name(a["family"], a["given"]))), lambda n: n.isNotNull()),
        )

    return _answered(rows.withColumn("__x", _json(_ITEMS)), "__x.message.items", made, WORK_TYPES[ITEMS_API], most)


def _answers(sources: DataFrame, responses: DataFrame, journal_base: str, most: int | None) -> DataFrame:
    """source, source_type, n, url, came, serves and articles of each candidate: one join on urls, no text is moved again."""
    told = sources.select("source", "name", F.lower(trimmed("source_type")).alias("source_type"), F.from_json(F.coalesce("config", F.lit("{}")), CONFIG).alias("__c"))
    # a url that answered more than once counts with its greatest body
    bodies = responses.where("url IS NOT NULL").groupBy("url").agg(F.max("body").alias("body"))
    rows = candidates(sources, journal_base).join(told.hint("merge"), "source").join(bodies.hint("merge"), "url", "left").withColumn("__id", F.lower(trimmed("__c.parser")) == JOURNAL_PAGES)
    lists = ~F.coalesce("__id", F.lit(False))
    forms = (
        (F.col("source_type") == FEED, _of_feeds), (F.col("source_type") == WORKS, _of_works), (F.col("source_type") == ITEMS_API, _of_items),
        ((F.col("source_type") == WEB) & lists, _of_lists), ((F.col("source_type") == WEB) & ~lists, _of_journal_pages),
    )
    came = rows.withColumn("came", F.col("body").isNotNull())
    made = [form(came.where(kind), most).select("source", "source_type", "n", "url", "came", F.coalesce(F.col("serves") & F.col("came"), F.lit(False)).alias("serves"), "articles") for kind, form in forms]
    every = made[0]
    for one in made[1:]:
        every = every.unionByName(one)
    return every


def outcomes(sources: DataFrame, responses: DataFrame, journal_base: str = "", most: int | None = ITEMS) -> DataFrame:
    """source, outcome, url, errors and articles (an array): what became of each source.

    The first candidate that serves counts: a web page that gives an article, a feed or an answer that can be read.
    ``served`` names its url; without one a source is ``failed`` if any candidate didn't come or couldn't be read (errors
    counts those tried), else ``empty``; ``none`` where it has no candidate, as sources kept by hand. Sources are rows with
    different source. Each gives its first ``most`` articles, or all of them for None.
    """
    answers = _answers(sources, responses, journal_base, most)
    bad = ~F.col("came") | ~F.col("serves") & (F.col("source_type") != WEB)
    best = F.when(F.col("serves"), F.col("n"))
    told = answers.groupBy("source").agg(F.min_by(F.struct("url", "articles"), best).alias("b"), F.min(best).alias("__n"), F.collect_list(F.when(bad, F.col("n"))).alias("__bad"))
    # what comes after the one that serves isn't tried
    told = told.withColumn("errors", F.size(F.filter("__bad", lambda i: F.col("__n").isNull() | (i < F.col("__n")))).cast("long"))
    rows = sources.select("source").join(told.hint("merge"), "source", "left")
    kind = F.when(F.col("errors").isNull(), "none").when(F.col("__n").isNotNull(), "served").when(F.col("errors") > 0, "failed").otherwise("empty")
    return rows.select("source", kind.alias("outcome"), F.when(F.col("__n").isNotNull(), F.col("b.url")).alias("url"), F.coalesce("errors", F.lit(0).cast("long")).alias("errors"), F.when(F.col("__n").isNotNull(), F.col("b.articles")).alias("articles"))


def articles(sources: DataFrame, outcomes_: DataFrame) -> DataFrame:
    """One row per article of the outcomes: source, n (from 0), its fields, language, and whether it needs review.

    Articles of web pages need it, unless the source's configuration trusts it.
    """
    config = F.from_json(F.coalesce("config", F.lit("{}")), CONFIG)
    web = F.lower(trimmed("source_type")) == WEB
    told = sources.select("source", given(F.col("language")).alias("__l"), web.alias("__web"), (web & ~F.coalesce(config["auto_publish"], F.lit(False))).alias("requires_review"), F.lower(trimmed("source_type")).alias("__t"))
    rows = outcomes_.where("outcome = 'served'").select("source", F.posexplode("articles").alias("n", "a")).join(told.hint("merge"), "source")
    language = F.coalesce("__l", F.when(F.col("__t").isin(WORKS, ITEMS_API), "en").otherwise("zh"))
    return rows.select("source", "n", "a.*", language.alias("language"), F.coalesce("requires_review", F.lit(False)).alias("requires_review"))


def with_abstracts(articles_: DataFrame, details: DataFrame, most: int = LOOKUPS) -> DataFrame:
    """Articles whose missing abstract is taken from details (doi, abstract), for the first ``most`` such with a doi of each source."""
    lacks = (F.col("abstract") == "") & (F.col("doi") != "")
    turn = F.sum(lacks.cast("int")).over(Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = articles_.withColumn("__ask", F.when(lacks & (turn <= most), F.lower("doi")))
    known = details.groupBy(F.lower(trimmed("doi")).alias("__ask")).agg(F.max(strip_tags(F.col("abstract"))).alias("__known"))
    return rows.join(known.hint("merge"), "__ask", "left").withColumn("abstract", F.coalesce(F.when(F.col("__ask").isNotNull(), F.col("__known")), "abstract")).drop("__ask", "__known")
