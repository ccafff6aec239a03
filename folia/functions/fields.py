"""Functions on columns of contents, feeds and requests: titles, page numbers, dates, authors, excerpts."""

from __future__ import annotations

import difflib
import ipaddress
import json
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from folia.functions.text import WHITE, let, nfkc, strip, trimmed

# Brackets, dashes and dots about a printed page number, and the numbers that count.
_BEFORE, _AFTER, MOST_PAGE = r"[\[\(（【<〈『「\-—–·\.]*", r"[\]\)）】>〉』」\-—–·\.]*", 3000
# What stands between a title and its page in contents, and a page's signs.
_DOTS, _SIGNS, _RANGE = r"[·•∙⋯…\.\s\x1c-\x1f]", r"[IVXLCDMivxlcdm\d]+", r"[-—–~～至]+"
# Titles that are no entries of contents, and authors who open a line.
NOISE_TITLES, AUTHOR_STARTS = ("目录", "插图目录", "插图", "封面", "书名", "书名页", "版权", "版权页"), ("卡·马克思", "弗·恩格斯", "马克思", "恩格斯")
# Signs at which a reply may end, where a cut leaves at least so many characters, and its length.
STOPS, LEAST_CUT, MOST_REPLY = "。！？；…", 40, 360
#: Characters of a highlight, terms of a highlight and of a gist.
HIGHLIGHT, TERMS = 160, 8
# Words that mean yes and no.
YES, NO = ("true", "1", "yes", "on", "是", "启用", "开放"), ("false", "0", "no", "off", "否", "停用", "关闭")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def given(text: Column) -> Column:
    """A text without blanks at its ends; null where nothing is left."""
    return F.nullif(trimmed(F.coalesce(text, F.lit(""))), F.lit(""))


# -- titles and contents -------------------------------------------------------------------------------


def clean_title(text: Column) -> Column:
    """NFKC, without NUL, white space collapsed."""
    return trimmed(F.regexp_replace(F.regexp_replace(nfkc(text), "\\x00", ""), f"(?U){WHITE}+", " "))


def clean_contents_line(line: Column) -> Column:
    """clean_title() with long dashes as hyphens."""
    return trimmed(F.regexp_replace(F.translate(nfkc(line), " —–", " --"), f"(?U){WHITE}+", " "))


def page_token(text: Column) -> Column:
    """The page number that a short text is: digits of 1 to 3000, or ``pre-`` and a roman number; decoration counts not."""
    return _page_token(trimmed(nfkc(text)))


def _page_token(own: Column) -> Column:
    number = _first(own, rf"(?U)^{WHITE}*{_BEFORE}{WHITE}*([0-9]{{1,4}}){WHITE}*{_AFTER}{WHITE}*$").cast("int")
    roman = _first(own, rf"(?iU)^{WHITE}*{_BEFORE}{WHITE}*([ivxlcdm]{{1,10}}){WHITE}*{_AFTER}{WHITE}*$")
    return F.coalesce(F.when(number.between(1, MOST_PAGE), number.cast("string")), F.concat(F.lit("pre-"), F.lower(roman)))


def contents_line(line: Column) -> Column:
    """(title, page) of a line of contents: leaders and a page or a range, else a range, else a trailing page.

    Where no form fits, or the page is no page number, the whole line is the title and page is null.
    """
    forms = (
        rf"(?U)^(.+?)(?:{_DOTS}{{2,}}|[·•∙⋯…\.]+{WHITE}*)({_SIGNS})(?:{WHITE}*{_RANGE}{WHITE}*({_SIGNS}))?{WHITE}*$",
        rf"(?U)^(.+?){WHITE}+({_SIGNS}){WHITE}*{_RANGE}{WHITE}*({_SIGNS}){WHITE}*$",
        rf"(?U)^(.+?){WHITE}+({_SIGNS}){WHITE}*$",
    )

    def parsed(text: Column) -> Column:
        found = [F.struct(trimmed(F.regexp_extract(text, p, 1)).alias("title"), _page_token(F.regexp_extract(text, p, 2)).alias("page")) for p in forms]
        fine = [F.when((f["title"] != "") & f["page"].isNotNull(), f) for f in found]
        return F.coalesce(*fine, F.struct(text.alias("title"), F.lit(None).cast("string").alias("page")))

    return let(clean_contents_line(line), parsed)


def is_numeric_title(title: Column) -> Column:
    return title.rlike(r"(?U)^[0-9IVXLCDMivxlcdm\s\x1c-\x1f\-—–\.]+$")


def is_navigable(title: Column) -> Column:
    """Whether a title is worth an entry: neither empty nor only numbers."""
    return (clean_title(title) != "") & ~is_numeric_title(clean_title(title))


def is_noise(title: Column, noise: tuple[str, ...] = NOISE_TITLES) -> Column:
    return F.replace(title, F.lit(" "), F.lit("")).isin(*noise) | is_numeric_title(title)


def carries_on(line: Column, noise: tuple[str, ...] = NOISE_TITLES) -> Column:
    """Whether a line of contents without a page goes on in the next: no noise, no author's line, over two characters."""
    compact = F.replace(line, F.lit(" "), F.lit(""))
    author = reduce(or_, [F.startswith(compact, F.lit(a)) for a in AUTHOR_STARTS]) & (F.length(line) <= 24)
    return ~is_noise(line, noise) & ~author & (F.length(line) > 2)


def without_date(title: Column) -> Column:
    """A title without the brackets at its end."""
    return trimmed(F.regexp_replace(title, r"(?U)[（(][^）)]*[）)][\s\x1c-\x1f]*$", ""))


def without_number(title: Column) -> Column:
    """A normalised title without the number before it."""
    return F.regexp_replace(title, r"^(?:[一二三四五六七八九十百零〇]+|[0-9]+)", "")


def dictionary_norm(text: Column) -> Column:
    """Lower case without what normalisation removes; angle brackets go too."""
    return F.regexp_replace(F.lower(strip(text)), "[〈〉]", "")


def paragraphs(text: Column) -> Column:
    """The parts between blank lines, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), rf"(?U)\n{WHITE}*\n"), lambda p: trimmed(p)), lambda p: p != "")


def clamp(value: Column, least: int, most: int) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(least), F.least(F.lit(most), value)))


def boolean_word(text: Column, default: bool = True) -> Column:
    """A setting's word as a boolean; the default for other words and null."""
    own = F.lower(trimmed(text))
    return F.when(own.isin(*NO), False).when(own.isin(*YES), True).otherwise(F.lit(default))


# -- excerpts ------------------------------------------------------------------------------------------


def collapsed(text: Column) -> Column:
    return trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?U){WHITE}+", " "))


def excerpt(text: Column, limit: int) -> Column:
    """White space collapsed; longer texts are cut and end in an ellipsis."""
    own = collapsed(text)
    return F.when(F.length(own) > limit, F.concat(trimmed(F.left(own, F.lit(limit))), F.lit("…"))).otherwise(own)


def sentence_excerpt(text: Column, limit: int = MOST_REPLY) -> Column:
    """Like excerpt(), but cut after the last stop that leaves enough; of several stop signs the first listed counts."""
    own = collapsed(text)
    head = F.left(own, F.lit(limit))
    last = lambda stop: F.length(head) - F.instr(F.reverse(head), stop)  # noqa: E731  zero-based place of the last one
    cuts = [F.when(F.contains(head, F.lit(s)) & (last(s) >= LEAST_CUT), F.left(head, last(s) + 1)) for s in STOPS]
    return F.when(F.length(own) <= limit, own).otherwise(F.coalesce(*cuts, F.concat(head, F.lit("……"))))


def highlight_terms(query: Column) -> Column:
    """What to mark of a query: itself, itself without blanks, and its tokens, the longest first; each once."""
    own = collapsed(query)
    compact = F.replace(own, F.lit(" "), F.lit(""))
    tokens = F.filter(F.split(own, r"(?U)[\s\x1c-\x1f，。；：、“”‘’？,.!?;:()（）【】《》]+"), lambda t: F.length(t) >= 2)
    placed = F.transform(tokens, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    longest = F.slice(F.transform(F.array_sort(placed), lambda x: x["t"]), 1, TERMS)
    one = F.when((compact != own) & (F.length(compact) >= 4), F.array(own, compact)).otherwise(F.array(own))
    return F.when(own == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(one, longest)))


def marked(context: Column, fallback: Column) -> Column:
    """The first marked stretch of a context, at most 160 characters."""
    found = collapsed(F.regexp_extract(context, r"(?s)\[\[H\]\](.*?)\[\[/H\]\]", 1))
    return F.when(found != "", F.left(found, F.lit(HIGHLIGHT))).otherwise(fallback)


def gist_terms(gist: Column, most: int = TERMS) -> Column:
    """The distinct words of a request that have two characters or more when normalised."""
    words = F.split(F.coalesce(gist, F.lit("")), r"(?U)[\s\x1c-\x1f,，、;；:：/|·\-—　]+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(strip(w)) >= 2)), 1, most)


def unique_keywords(words: Column, most: int = TERMS) -> Column:
    """Normalised keywords of two characters or more, each once."""
    return F.slice(F.array_distinct(F.filter(F.transform(words, strip), lambda w: F.length(w) >= 2)), 1, most)


def without_thinking(text: Column) -> Column:
    """A model's answer without its thinking: closed blocks go, an open one goes up to the next blank line or heading."""
    closed = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.regexp_replace(F.regexp_replace(closed, r"(?is)^.*?<think>.*?(?=\n\s*\n|\n#)", ""), f"(?U)^{WHITE}+|{WHITE}+$", "")


# -- feeds ---------------------------------------------------------------------------------------------


def meta_description(html: Column) -> Column:
    """The description that a page's head gives; empty where there is none. Entities stay."""
    return trimmed(F.regexp_extract(html, r"""(?is)<meta\b[^>]*(?:name|property)\s*=\s*["'](?:description|og:description)["'][^>]*content\s*=\s*["']([^"']+)["']""", 1))


def split_authors(text: Column) -> Column:
    """Authors of a list, without the numbers in brackets behind them."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[^\]]*\]", "")
    return F.filter(F.split(plain, r"(?U)[;,，、\s\x1c-\x1f]+"), lambda a: a != "")


def author_name(family: Column, given_name: Column) -> Column:
    return F.concat_ws(" ", given(family), given(given_name))


def page_range(first: Column, last: Column) -> Column:
    """``first-last``, or the one of them that there is; empty where there is none."""
    a, b = given(first), given(last)
    return F.coalesce(F.when(a != b, F.concat_ws("-", a, b)), a, b, F.lit(""))


def iso_date(*parts: Column) -> Column:
    """yyyy-mm-dd of the first of some [year, month, day] arrays that isn't empty; what is missing is 1."""
    at = lambda p, i: F.coalesce(F.get(p, F.lit(i)), F.lit(1))
    return F.coalesce(*[F.when(F.size(p) > 0, F.format_string("%04d-%02d-%02d", F.get(p, F.lit(0)), at(p, 1), at(p, 2))) for p in parts], F.lit(""))


def latest_possible(published: Column) -> Column:
    """The last day that a date can mean: a day itself, a month's 28th; null for a year alone and for no date."""
    own = trimmed(F.coalesce(published, F.lit("")))
    day, month = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{4})-(\d{1,2})$"
    part = lambda p, i: F.lpad(F.regexp_extract(own, p, i), 2, "0")
    text = F.when(own.rlike(day), F.concat_ws("-", F.regexp_extract(own, day, 1), part(day, 2), part(day, 3))).when(own.rlike(month), F.concat_ws("-", F.regexp_extract(own, month, 1), part(month, 2), F.lit("28")))
    return F.try_to_date(text, "yyyy-MM-dd")


def is_placeholder_date(published: Column, source_id: Column) -> Column:
    """Whether a date is only a stand-in: none, a year alone, or a first of January from a source that writes such."""
    own = trimmed(F.coalesce(published, F.lit("")))
    return (own == "") | own.rlike(r"^\d{4}$") | (F.coalesce(source_id, F.lit("")) != "") & F.endswith(own, F.lit("-01-01"))


def clock(text: Column, fallback: str = "08:00") -> Column:
    """hh:mm with hours up to 23 and minutes up to 59; the fallback for anything else."""
    form = r"^(\d{1,2}):(\d{2})$"
    own = trimmed(F.coalesce(text, F.lit("")))
    part = lambda i, most: F.lpad(F.least(F.regexp_extract(own, form, i).cast("int"), F.lit(most)).cast("string"), 2, "0")
    return F.when(own.rlike(form), F.concat_ws(":", part(1, 23), part(2, 59))).otherwise(fallback)


def bibliography(authors: Column, title: Column, journal: Column, year: Column, volume: Column, issue: Column, pages: Column, doi: Column, language: Column) -> Column:
    """A numbered-style citation: up to three authors, then what is known of the issue, pages and doi."""
    more = F.when(F.startswith(F.lower(F.coalesce(language, F.lit(""))), F.lit("zh")), ", 等").otherwise(", et al")
    who = F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.when(F.size(authors) > 3, more).otherwise(""))
    v, i = given(volume), given(issue)
    number = F.when(v.isNotNull() & i.isNotNull(), F.concat(F.lit(", "), v, F.lit("("), i, F.lit(")"))).when(v.isNotNull(), F.concat(F.lit(", "), v)).when(i.isNotNull(), F.concat(F.lit(", ("), i, F.lit(")"))).otherwise("")
    tail = F.concat(F.coalesce(F.concat(F.lit(": "), given(pages)), F.lit("")), F.coalesce(F.concat(F.lit(". DOI: "), given(doi)), F.lit("")), F.lit("."))
    when = F.coalesce(F.left(given(year), F.lit(4)), F.lit("出版年不详"))
    return F.concat(F.coalesce(given(who), F.lit("佚名")), F.lit(". "), trimmed(F.coalesce(title, F.lit(""))), F.lit("[J]. "), trimmed(F.coalesce(journal, F.lit(""))), F.lit(", "), when, number, tail)


def json_strings(text: Column) -> Column:
    """A JSON array of strings; an empty array where the text is none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def brace_slice(text: Column) -> Column:
    """From the first opening brace to the last closing one."""
    return _first(text, r"(?s)(\{.*\})")


@F.pandas_udf(StringType())
def json_in(texts: pd.Series) -> pd.Series:
    """The JSON value in a model's answer, canonical: of a fence, of the whole text, else the first balanced one, else ``{}``."""

    def found(text: str | None) -> str:
        own = (text or "").strip()
        parts = own.split("```")
        if len(parts) >= 3:
            own = parts[1].removeprefix("json").strip()
        decoder = json.JSONDecoder()
        for at in [0, *sorted(i for i in (own.find("{"), own.find("[")) if i >= 0)][:2]:
            try:
                value, end = decoder.raw_decode(own[at:])
            except (ValueError, RecursionError):
                continue
            if at or not own[end:].strip():
                return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return "{}"

    return texts.map(found)


# -- requests ------------------------------------------------------------------------------------------


def actor_key(user_id: Column, ip: Column, session: Column) -> Column:
    """``user:``, ``ip:`` or ``session:`` and the first of them that there is."""
    own = F.coalesce(given(session), F.lit("anonymous"))
    return F.coalesce(F.concat(F.lit("user:"), F.nullif(user_id, F.lit(0)).cast("string")), F.concat(F.lit("ip:"), given(ip)), F.concat(F.lit("session:"), own))


def client_ip(forwarded: Column, remote: Column) -> Column:
    """The last address of a forwarding header, which the own proxy wrote; else the remote one, else unknown."""
    parts = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda p: trimmed(p)), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), given(remote), F.lit("unknown"))


def feature_of(endpoint: Column, origin: Column) -> Column:
    """The feature that a request counts for; null where it counts for none."""
    own = F.coalesce(endpoint, F.lit(""))
    return (
        F.when(own.isin("", "static", "page_image", "api_ping", "api_shutdown"), None)
        .when(own == "api_search", "search")
        .when(own.isin("reader", "library", "pdf_viewer", "serve_pdf"), "reader")
        .when(F.startswith(own, F.lit("api_ai_")), "ai")
        .when((own == "pricing") & (trimmed(F.coalesce(origin, F.lit(""))) == "journal"), "pricing_journal")
        .when(own == "pricing", "pricing")
        .otherwise("site")
    )


def email(text: Column) -> Column:
    return F.lower(trimmed(text))


def masked(token: Column) -> Column:
    return F.sha2(trimmed(F.coalesce(token, F.lit(""))), 256)


@F.pandas_udf(BooleanType())
def is_public_ip(ips: pd.Series) -> pd.Series:
    """Whether an address is one of the public internet; false for what is no address."""

    def public(ip: str | None) -> bool:
        try:
            return ipaddress.ip_address((ip or "").strip()).is_global
        except ValueError:
            return False

    return ips.map(public)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two short texts by their matching blocks, 0 to 1."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


