"""Articles of feeds: selection, detail merge, batches, review lists, recipients and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.text import trimmed
from folia.functions.fields import bibliography, email, given, is_placeholder_date, latest_possible

# Lengths of a title, and titles and parts of titles that are no articles'.
SHORTEST, LONGEST, SHORT_TITLE = 4, 160, 16
NO_ARTICLE = (
    "首页", "上一页", "下一页", "更多", "投稿", "登录", "注册", "目录", "期刊简介", "联系我们", "版权声明",
    "总目录", "本期目录", "封二", "封三", "封底", "插页", "彩页", "更正", "勘误",
)
NO_ARTICLE_PARTS_EN = (
    "table of contents", "editorial board", "editorial note", "issue information", "front matter", "back matter", "masthead",
    "call for papers", "announcement", "in memoriam", "erratum", "corrigendum", "correction to", "list of contributors", "acknowledgment",
    "advertisement", "cover image", "frontispiece", "index to volume",
)
NO_ARTICLE_PARTS_ZH = (
    "目录", "总目次", "目次", "要目", "卷首语", "编者按", "编后", "编辑部", "稿约", "征稿", "征订", "启事", "声明", "通知", "公告", "贺信", "贺词", "祝词",
    "要闻", "简讯", "快讯", "学界动态", "广告", "招聘", "致谢", "鸣谢", "撤稿", "投稿须知", "约稿", "中心简介", "机构简介",
    "我校", "我院", "本校", "本院", "召开", "隆重举行", "封面", "封二", "封三", "封底", "彩页", "插页", "图片报道", "图片新闻",
)
# States of articles and batches.
WAITING, OPEN_BATCH = ("pending_review", "ready", "translation_pending"), ("collecting", "reviewing", "ready_to_send")
#: Days between sendings, authors of a brief, characters of its abstract.
INTERVAL_DAYS, BRIEF_AUTHORS, BRIEF_ABSTRACT = {"daily": 1, "weekly": 7, "biweekly": 14, "monthly": 28}, 5, 600


def is_article_title(title: Column) -> Column:
    """Whether a title can be an article's: by length, lists of others, numbers only, and some letter.

    Parts in Chinese tell in short titles, and at the start or end of long ones.
    """
    own, parts = trimmed(title), "|".join(NO_ARTICLE_PARTS_ZH)
    english = F.lower(own).rlike("|".join(NO_ARTICLE_PARTS_EN))
    chinese = own.rlike(f"^(?:{parts})|(?:{parts})$") | (F.length(own) <= SHORT_TITLE) & own.rlike(parts)
    numbers = own.rlike(r"^[第\d\s年卷期页\-—~、.,()（）]+$")
    return F.coalesce(F.length(title).between(SHORTEST, LONGEST) & ~own.isin(*NO_ARTICLE) & ~english & ~chinese & ~numbers & title.rlike("[一-鿿A-Za-z]"), F.lit(False))


def is_allowed_type(kind: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a work's type is among those wanted; works without a type are kept."""
    own = F.lower(trimmed(F.coalesce(kind, F.lit(""))))
    return (own == "") | own.isin(*allowed)


def in_window(published: Column, cutoff: Column) -> Column:
    """Whether a date can lie on or after the cutoff; unknown ones are out only by their year."""
    bound, year = latest_possible(published), F.regexp_extract(F.coalesce(published, F.lit("")), r"^(\d{4})", 1)
    return F.when(bound.isNotNull(), bound >= F.to_date(cutoff)).otherwise((year == "") | (year.try_cast("int") >= F.year(cutoff)))


def collect(articles: DataFrame, sources: DataFrame, cutoff: Column) -> DataFrame:
    """Articles (source, title, type, published_at, ...) of enabled sources that are articles and in the window.

    Adds status: ready, or pending_review where the source is a web page that isn't trusted.
    """
    enabled = sources.where("is_enabled").select("source", F.col("source_type").alias("__type"), F.col("auto_publish").alias("__auto"))
    kept = articles.join(enabled, "source").where(is_article_title(F.col("title")) & in_window(F.col("published_at"), cutoff))
    status = F.when((F.col("__type") == "web_html") & ~F.col("__auto"), "pending_review").otherwise("ready")
    return kept.withColumn("status", status).drop("__type", "__auto")


def merge_details(articles: DataFrame, details: DataFrame) -> DataFrame:
    """Articles with what their details add: blanks are filled, stand-in dates replaced, the citation made anew.

    Both have article_id, abstract, authors, published_at, pages, doi, issue; articles also title, journal,
    volume, language and source_id.
    """
    rows = articles.alias("a").join(details.alias("d"), "article_id", "left")
    fill = lambda c: F.coalesce(given(F.col(f"a.{c}")), F.col(f"d.{c}"), F.lit("")).alias(c)
    authors = F.when(F.size("a.authors") > 0, F.col("a.authors")).otherwise(F.coalesce("d.authors", "a.authors"))
    stand_in = is_placeholder_date(F.col("a.published_at"), F.col("a.source_id")) & given(F.col("d.published_at")).isNotNull()
    published = F.when(stand_in, F.col("d.published_at")).otherwise(F.col("a.published_at"))
    merged = rows.select(
        "article_id", "a.title", "a.journal", "a.volume", "a.language", "a.source_id", authors.alias("authors"), published.alias("published_at"), *map(fill, ("abstract", "pages", "doi", "issue"))
    )
    return merged.withColumn("citation", bibliography(*map(F.col, ("authors", "title", "journal", "published_at", "volume", "issue", "pages", "doi", "language"))))


def archive_batches(batches: DataFrame, articles: DataFrame, delete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(batches, articles) after all unsent batches are archived, and with them, or without a batch, what still waits.

    With ``delete`` waiting articles go.
    """
    old = F.col("status").isin(*OPEN_BATCH)
    closed = batches.where(old).select("batch_id", F.lit(True).alias("__old"))
    rows = articles.join(closed, "batch_id", "left")
    waits = F.col("status").isin(*WAITING) & (F.col("__old") | F.col("batch_id").isNull())
    waits = F.coalesce(waits, F.lit(False))
    rows = rows.where(~waits) if delete else rows.withColumn("status", F.when(waits, "archived").otherwise(F.col("status")))
    return batches.withColumn("status", F.when(old, "archived").otherwise(F.col("status"))), rows.drop("__old").select(articles.columns)


def next_state(state: Column, reviewed: Column, sent: Column) -> Column:
    """A batch's next state: it is collected, reviewed, made ready, sent; archived and sent ones stay."""
    return F.when(state == "collecting", "reviewing").when((state == "reviewing") & reviewed, "ready_to_send").when((state == "ready_to_send") & sent, "sent").otherwise(state)


def public_batch(batches: DataFrame) -> DataFrame:
    """The batch to show: the last sent one, else the latest that isn't archived."""
    rank = F.when(F.col("status") == "sent", 0).otherwise(1)
    return batches.where("status <> 'archived'").orderBy(rank, F.desc("created_at"), F.desc("batch_id")).limit(1)


def review_list(articles: DataFrame, disciplines: list[str], rest: str) -> DataFrame:
    """Articles by discipline in a fixed order, those without or of others last, numbered over all of them.

    Numbers come from ranks within a discipline and its offset, so no task holds all articles.
    """
    known = F.col("discipline").isin(*disciplines)
    place = F.coalesce(F.array_position(F.array(*[F.lit(d) for d in disciplines]), F.when(known, F.col("discipline"))), F.lit(len(disciplines) + 1))
    rows = articles.withColumn("discipline", F.when(known, F.col("discipline")).otherwise(rest)).withColumn("place", place.cast("int"))
    sizes = rows.groupBy("place").agg(F.count("*").alias("__n"))
    offset = F.coalesce(F.sum("__n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("place").orderBy("article_id"))
    return rows.join(sizes.withColumn("__before", offset), "place").withColumn("ref", (own + F.col("__before")).cast("long")).drop("__n", "__before")


def brief(authors: Column, title_zh: Column, title: Column, abstract: Column) -> Column:
    """What a review shows of an article: translated title if any, some authors, a clipped abstract."""
    return F.struct(
        F.coalesce(given(title_zh), given(title), F.lit("")).alias("title"),
        F.array_join(F.slice(authors, 1, BRIEF_AUTHORS), "、").alias("authors"),
        F.left(trimmed(F.coalesce(abstract, F.lit(""))), F.lit(BRIEF_ABSTRACT)).alias("abstract"),
    )


def translation_status(language: Column, title_zh: Column, abstract: Column, abstract_zh: Column) -> Column:
    """Whether an article is ready: English ones need a translated title, and an abstract if they have one."""
    english = F.startswith(F.lower(F.coalesce(language, F.lit(""))), F.lit("en"))
    done = given(title_zh).isNotNull() & (given(abstract_zh).isNotNull() | given(abstract).isNull())
    return F.when(~english | done, "ready").otherwise("translation_pending")


def send_due(frequency: Column, weekday: Column, now: Column, hours: int = 8) -> Column:
    """Whether now is a sending day: every day, or where weekly and biweekly the chosen weekday (0 is Monday) in local time."""
    local = now + F.expr(f"INTERVAL {hours} HOURS")
    return ~F.lower(frequency).isin("weekly", "biweekly") | (F.weekday(local) == weekday)


def collect_due(frequency: Column, weekday: Column, now: Column, last_batch: Column, paused: Column, hours: int = 8) -> Column:
    """Whether now is the day before a sending day; biweekly and monthly also wait since the last batch."""
    tomorrow = now + F.expr(f"INTERVAL {hours} HOURS") + F.expr("INTERVAL 1 DAY")
    kind = F.lower(frequency)
    since = F.unix_timestamp(now) - F.unix_timestamp(last_batch)
    least = F.when(kind == "biweekly", INTERVAL_DAYS["biweekly"]).otherwise(INTERVAL_DAYS["monthly"])
    early = kind.isin("biweekly", "monthly") & F.coalesce(since < (least - 2) * 86400, F.lit(False))
    day = ~kind.isin("weekly", "biweekly") | (F.weekday(tomorrow) == weekday)
    return ~paused & ((kind == "daily") | (day & ~early))


def source_state(sources: DataFrame) -> DataFrame:
    """Adds complete, auto_send and label: whether a source can be collected, and sent without review."""
    kind = F.lower(F.coalesce(given(F.col("source_type")), F.lit("manual")))
    lacks_issn = kind.isin("openalex", "crossref") & given(F.col("issn")).isNull()
    lacks_url = kind.isin("rss", "web_html") & F.coalesce(given(F.col("source_url")), given(F.col("entry_url"))).isNull()
    lacks_parser = (kind == "web_html") & given(F.col("parser")).isNull()
    complete = (kind != "manual") & ~lacks_issn & ~lacks_url & ~lacks_parser
    auto = complete & ((kind != "web_html") | F.coalesce(F.col("auto_publish"), F.lit(False)))
    label = F.when(~F.col("is_enabled"), "已停用").when(auto, "可自动抓取·自动发送").when(complete, "可自动抓取·人工审核").otherwise("待补充来源")
    return sources.withColumn("complete", complete).withColumn("auto_send", auto).withColumn("label", label)


def completeness_by_language(sources: DataFrame) -> DataFrame:
    rows = source_state(sources)
    return rows.groupBy("language").agg(F.count("*").alias("sources"), F.count_if("complete").alias("complete"), F.count_if("auto_send").alias("auto_send"))


def backfill_sources(sources: DataFrame, defaults: DataFrame, stale: str) -> DataFrame:
    """Sources with the defaults' type, issn, url and config where theirs are blank, stale or to be upgraded.

    Blank: manual and nothing set. Stale: url or config match the pattern of addresses that are gone. Upgraded:
    the default isn't manual, and the row is, or lacks the default's code. Defaults without a row come in.
    """
    names = ("source_type", "issn", "source_url", "config")
    plain = sources.select("source", *[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("__has"))
    rows = defaults.join(plain, "source", "full")
    kind, default = F.lower(F.coalesce(given(F.col("__source_type")), F.lit("manual"))), F.lower(F.coalesce(given(F.col("source_type")), F.lit("manual")))
    blank = (kind == "manual") & given(F.col("__issn")).isNull() & given(F.col("__source_url")).isNull() & F.coalesce(given(F.col("__config")), F.lit("{}")).isin("{}")
    old = F.concat_ws(" ", "__source_url", "__config").rlike(stale)
    code = given(F.col("code"))
    lacks = F.coalesce(code.isNotNull() & ~F.contains(F.coalesce("__config", F.lit("")), code), F.lit(False))
    take = F.col("source_type").isNotNull() & (F.col("__has").isNull() | blank | old | ((default != "manual") & ((kind == "manual") | lacks)))
    return rows.select("source", *[F.when(take, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in names], take.alias("changed"))


def recipients(mode: str, subscriptions: DataFrame, members: DataFrame, users: DataFrame, named: DataFrame, delivered: DataFrame) -> DataFrame:
    """email of those that a mode addresses, each once, without those who have it already."""
    rows = {"members": members, "registered": users, "specific": named}.get(mode, subscriptions)
    addresses = rows.select(email(F.col("email")).alias("email")).where("email <> ''").distinct()
    return addresses.join(delivered.select(email(F.col("email")).alias("email")), "email", "left_anti")


def digests(pairs: DataFrame, articles: DataFrame, subscriptions: DataFrame, most: int = 50) -> DataFrame:
    """One row per active subscription: status and the first articles to send of those in pairs, by number.

    Subscriptions without an address fail, those without articles are skipped. Articles are ranked before
    they are gathered, so a list is never longer than ``most``.
    """
    rank = F.row_number().over(Window.partitionBy("subscription_id").orderBy("article_id"))
    few = pairs.join(articles.select("article_id", "title"), "article_id").withColumn("r", rank).where(F.col("r") <= most)
    lists = few.groupBy("subscription_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]), "; ").alias("digest"), F.count("*").alias("articles"))
    rows = subscriptions.join(lists, "subscription_id", "left")
    status = F.when(given(F.col("email")).isNull(), "failed").when(F.col("articles").isNull(), "skipped").otherwise("sent")
    return rows.select("subscription_id", status.alias("status"), F.when(status == "sent", F.col("digest")).alias("digest"), F.coalesce("articles", F.lit(0)).alias("articles"))
