"""Tables of contents from the corpus itself: contents pages, titles in page heads, pairing of titles.

pages have source_file, pdf_page, raw_text and printed_page; marks (bookmarks) source_file, mark_no, title, pdf_page
and level. Pages of contents are few in a volume, so what folds over their lines takes a volume at a time; everything
over all pages is joined on keys.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.fields import carries_on, clean_title, contents_line, is_noise, is_numeric_title, page_token, ratio
from folia.functions.text import normalize, trimmed
from folia.functions.windows import following_known
from folia.session import written

# The word that heads contents, pages that are looked through, pages that follow the first, lines with a
# page number on the first and on others, and the marks that are good enough: how many, and which share of all.
CATALOG, LOOK, FOLLOW, FIRST_LINES, NEXT_LINES, GOOD_MARKS, GOOD_SHARE = "目录", 40, 7, 3, 6, 10, 0.12
# Characters of a title that a page's head must hold, of the head, and of the head that errors are looked
# for in; the likeness that is enough, and the length of a title that may have errors.
KEY, HEAD, LONG_HEAD, LIKE, LEAST_LIKE = 12, 50, 90, 0.55, 4
# A date in brackets on a line of its own, the same after a page number, sections, what ends a title,
# a page at its end, and heads of contents pages.
DATE_LINE = r"[（(]\s*[12０-９0-9\s]{4,}年[^）)]{0,30}[日月][^）)]{0,16}[)）]?\s*"
SECTION, TITLE_END, PAGE_END, CONTENTS_HEAD = r"[一二三四五六七八九十]{1,3}、", r"[·⋯…\.、\s\d—一–\-]+$", r"[·⋯…\.\s]*\d{1,3}\s*$", r"目录|第[一二三四五]卷"
# A date in brackets within a page's head, and characters that a chapter's title does not have.
DATE, NO_TITLE = r"[（(]\s*[一二三四五六七八九十百零〇○二〇\d]{2,}\s*年[^）)]{0,16}?[日月][^）)]{0,12}[)）]", r"[。！？；，、⋯…·.0123456789—–\-]"

#: Titles or marks of a file that are compared as one block.
BLOCK = 1024

_LINES, _WHITE = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]", r"(?U)[\s\x1c-\x1f]+"


def page_lines(pages: DataFrame) -> DataFrame:
    """source_file, pdf_page, line_no and line: the lines of pages with text, cleaned like titles."""
    lines = pages.select("source_file", "pdf_page", F.posexplode(F.split(F.coalesce("raw_text", F.lit("")), _LINES)).alias("line_no", "raw"))
    return lines.select("source_file", "pdf_page", "line_no", clean_title(F.col("raw")).alias("line")).where("line <> ''")


# -- contents pages ------------------------------------------------------------------------------------


def contents_pages(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """source_file, pdf_page of the pages of contents.

    A page opens contents if the word for them is in its first four lines and three lines or more end with a page;
    it follows if it opens or six lines do. The first page that opens counts, of those that marks call contents, in
    the order of marks, or where there is no such mark of the first 40; then up to seven pages that follow.
    """
    named = marks.where(F.contains(F.replace(clean_title(F.col("title")), F.lit(" "), F.lit("")), F.lit(CATALOG)))
    named = named.groupBy("source_file", "pdf_page").agg(F.min("mark_no").alias("place"))
    near = named.select("source_file", F.explode(F.sequence(F.col("pdf_page"), F.col("pdf_page") + FOLLOW)).alias("pdf_page")).distinct()
    slim = pages.select("source_file", "pdf_page", "raw_text")
    looked = slim.where(F.col("pdf_page") <= LOOK + FOLLOW).unionByName(slim.where(F.col("pdf_page") > LOOK + FOLLOW).join(near, ["source_file", "pdf_page"]))
    lines = page_lines(looked).withColumn("hit", contents_line(F.col("line"))["page"].isNotNull().cast("int"))
    each = lines.groupBy("source_file", "pdf_page").agg(F.sum("hit").alias("hits"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    head = F.replace(F.array_join(F.transform(F.slice("lines", 1, 4), lambda x: x["line"]), ""), F.lit(" "), F.lit(""))
    opens = F.contains(head, F.lit(CATALOG)) & (F.col("hits") >= FIRST_LINES)
    each = each.select("source_file", "pdf_page", opens.alias("opens"), (opens | (F.col("hits") >= NEXT_LINES)).alias("follows"))

    files = named.select("source_file").distinct().withColumn("named", F.lit(True))
    seeds = each.where("opens").join(files, "source_file", "left").join(named, ["source_file", "pdf_page"], "left")
    seeds = seeds.where(f"if(named, place IS NOT NULL, pdf_page <= {LOOK})").groupBy("source_file").agg(F.min_by("pdf_page", F.struct("place", "pdf_page")).alias("first"))
    after = each.join(seeds, "source_file").where(f"follows AND pdf_page > first AND pdf_page <= first + {FOLLOW}")
    # consecutive ones only: each is as far from the first as there are such pages up to it
    order = Window.partitionBy("source_file").orderBy("pdf_page")
    after = after.withColumn("at", F.row_number().over(order)).where("pdf_page = first + at").select("source_file", "pdf_page")
    return seeds.select("source_file", F.col("first").alias("pdf_page")).unionByName(after)


def page_map(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """source_file, token and page: the first page with each printed label, else that of the first mark that is a page number."""
    printed = pages.where("printed_page <> ''").select("source_file", F.col("printed_page").alias("token"), "pdf_page", F.lit(0).alias("kind"), F.col("pdf_page").alias("place"))
    numbers = marks.select("source_file", page_token(F.col("title")).alias("token"), "pdf_page", F.lit(1).alias("kind"), F.col("mark_no").alias("place")).where("token IS NOT NULL")
    both = printed.unionByName(numbers)
    return both.groupBy("source_file", "token").agg(F.min_by("pdf_page", F.struct("kind", "place")).alias("page"))


def parsed_contents(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Entries (source_file, title, pdf_page, level, sort_order) read from the lines of contents pages.

    A line without a page goes on in the next line that has one, unless one that cannot go on stands between;
    noise is passed over. Pages are found by page_map(); entries whose page isn't there, or that stand twice, go.
    """
    lines = page_lines(pages.join(contents_pages(pages, marks), ["source_file", "pdf_page"], "left_semi"))
    lines = lines.where(~is_noise(F.col("line"))).withColumn("entry", contents_line(F.col("line")))
    token = F.col("entry")["page"]
    lines = lines.withColumn("ends", token.isNotNull() | ~carries_on(F.col("line")))
    order = Window.partitionBy("source_file").orderBy("pdf_page", "line_no")
    # lines up to and with the one that ends them are a group
    lines = lines.withColumn("group", F.sum(F.col("ends").cast("int")).over(order) - F.col("ends").cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("pdf_page", "line_no", F.col("entry")["title"].alias("title"), F.col("line").alias("line"), token.alias("token"))))
    groups = lines.groupBy("source_file", "group").agg(parts.alias("parts")).withColumn("last", F.element_at("parts", -1)).where("last.token IS NOT NULL")
    carried = F.array_join(F.transform(F.slice("parts", F.lit(1), F.size("parts") - 1), lambda p: p["line"]), "")
    groups = groups.select("source_file", clean_title(F.concat(carried, F.col("last.title"))).alias("title"), F.col("last.token").alias("token"))
    found = groups.where((F.col("title") != "") & ~is_noise(F.col("title"))).join(page_map(pages, marks), ["source_file", "token"])
    found = found.select("source_file", "title", F.col("page").alias("pdf_page")).distinct()
    number = F.row_number().over(Window.partitionBy("source_file").orderBy("pdf_page", "title"))
    return found.select("source_file", "title", "pdf_page", F.lit(1).alias("level"), number.alias("sort_order"))


def chosen_contents(entries: DataFrame, pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Each file's contents (source_file, title, pdf_page, level, sort_order, origin).

    Given entries come first, then its marks that are titles, if these are ten or more and 12 % of all its
    marks, then entries parsed from contents pages, then its marks after all.
    """
    clean = marks.select("source_file", "mark_no", clean_title(F.col("title")).alias("title"), "pdf_page", F.greatest(F.col("level"), F.lit(1)).alias("level")).where("title <> '' AND pdf_page >= 1")
    # written, as Spark can't plan functions in Python over groups whose keys are such functions themselves
    clean = written(clean.groupBy("source_file", "level", "pdf_page", "title").agg(F.min("mark_no").alias("mark_no")))
    titles = clean.withColumn("titled", ~is_numeric_title(F.col("title")))
    good = titles.groupBy("source_file").agg(F.sum(F.col("titled").cast("int")).alias("n"), F.count("*").alias("every"))
    good = good.where(f"n >= {GOOD_MARKS} AND n >= {GOOD_SHARE} * every").select("source_file")
    titles = titles.where("titled").select("source_file", "title", "pdf_page", "level", F.col("mark_no").alias("sort_order"))
    given = entries.select("source_file", "title", "pdf_page", F.col("level").cast("int").alias("level"), "sort_order")
    parsed = parsed_contents(pages, clean)

    out = given.withColumn("origin", F.lit("given"))
    for own, origin in ((titles.join(good, "source_file", "left_semi"), "marks"), (parsed, "parsed"), (titles, "marks")):
        out = out.unionByName(own.withColumn("origin", F.lit(origin)).join(out.select("source_file").distinct(), "source_file", "left_anti"))
    return out


# -- contents whose entries end with dates ---------------------------------------------------------------


def dated_entries(lines: Iterable[str], heads: str = CONTENTS_HEAD) -> list[tuple[str, str, int | None]]:
    """(kind, title, page) of contents in which a date on a line of its own ends an entry.

    Sections stand between entries and may go on for one short line without a page.
    """
    out: list[tuple[str, str, int | None]] = []
    held: list[str] = []
    open_section = False

    def bare(text: str) -> str:
        return re.sub(TITLE_END, "", text).strip()

    def end() -> None:
        whole = "".join(held)
        page, title = re.search(r"(\d{1,3})\s*$", whole), bare(whole)
        held.clear()
        if 2 <= len(title) <= 60:
            out.append(("body", title, int(page[1]) if page else None))

    for line in map(str.strip, lines):
        if not line or re.fullmatch(heads, re.sub(r"\s", "", line)):
            continue
        dated = re.fullmatch(rf"(\d{{1,3}}\s*)?{DATE_LINE}", line)
        if dated:
            if held:
                held.extend([dated[1].strip()] if dated[1] else [])
                end()
                open_section = open_section and out[-1][0] == "section"
        elif not held and re.match(SECTION, line):
            out.append(("section", bare(line), None))
            open_section = True
        elif not held and open_section and len(line) <= 8 and not re.search(PAGE_END, line):
            kind, title, _ = out[-1]
            out[-1] = (kind, title + bare(line), None)
            open_section = False
        else:
            held.append(line)
    if held:
        end()
    return out


def dated_contents(pages: DataFrame, body: int = 40) -> DataFrame:
    """Entries (source_file, entry_no, kind, title, page, ends_at) of contents whose entries end with dates.

    They begin on the first page before ``body`` with the word for contents alone on one of its first two
    lines, and go on while each page has two dates or more, or is blank; ends_at is the last page.
    """
    slim = pages.select("source_file", "pdf_page", F.split(F.coalesce("raw_text", F.lit("")), _LINES).alias("lines"))
    lines = F.filter("lines", lambda x: F.regexp_replace(x, _WHITE, "") != "")
    dates = F.size(F.filter(lines, lambda x: trimmed(x).rlike(rf"^(?:\d{{1,3}}\s*)?{DATE_LINE}$")))
    slim = slim.withColumn("fits", (dates >= 2) | (F.size(lines) == 0))
    slim = slim.withColumn("opens", (F.col("pdf_page") < body) & F.exists(F.slice(lines, 1, 2), lambda x: F.regexp_replace(x, _WHITE, "") == CATALOG))
    first = slim.where("opens").groupBy("source_file").agg(F.min("pdf_page").alias("first"))
    rows = slim.join(first, "source_file").where("pdf_page >= first")
    order = Window.partitionBy("source_file").orderBy("pdf_page")
    rows = rows.where("fits OR pdf_page = first").withColumn("at", F.row_number().over(order)).where("pdf_page = first + at - 1")

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pdf_page")
        found = dated_entries(line for page in frame["lines"] for line in page)
        held = pd.DataFrame(found, columns=["kind", "title", "page"]).astype({"page": "Int64"})
        return held.assign(source_file=frame["source_file"].iloc[0], entry_no=range(1, len(held) + 1), ends_at=frame["pdf_page"].max())

    schema = "kind string, title string, page long, source_file string, entry_no int, ends_at int"
    return rows.select("source_file", "pdf_page", "lines").groupBy("source_file").applyInPandas(f, schema).select("source_file", "entry_no", "kind", "title", "page", "ends_at")


# -- titles in page heads --------------------------------------------------------------------------------


def best_chain(candidates: Iterable[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Of candidates (entry, page, weight) the chain of rising entries and pages that weighs most.

    A tree of prefix maxima over pages holds the best chain that ends before each.
    """
    rows = sorted(candidates, key=lambda c: (c[0], -c[1], c[2]))
    places = sorted({page for _, page, _ in rows})
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(places) + 1)
    back: list[int] = []
    top = (0.0, -1)
    for i, (_, page, weight) in enumerate(rows):
        at = bisect_left(places, page)
        best, k = (0.0, -1), at
        while k:
            best, k = max(best, tree[k], key=lambda x: x[0]), k & (k - 1)
        back.append(best[1])
        held = (best[0] + weight, i)
        top = max(top, held, key=lambda x: x[0])
        k = at + 1
        while k < len(tree):
            tree[k], k = max(tree[k], held, key=lambda x: x[0]), k + (k & -k)
    chain, i = [], top[1]
    while i >= 0:
        chain.append(rows[i][:2])
        i = back[i]
    return chain[::-1]


def _per_file(candidates: DataFrame, choose: Callable[[list[tuple]], list[tuple[int, int]]], columns: tuple[str, str, str]) -> DataFrame:
    """What choose() takes of each file's candidates, as source_file and the first two columns."""
    a, b, weight = columns

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        chosen = choose(list(zip(frame[a].tolist(), frame[b].tolist(), frame[weight].tolist(), strict=True)))
        return pd.DataFrame({"source_file": frame["source_file"].iloc[0], a: [c[0] for c in chosen], b: [c[1] for c in chosen]}, columns=["source_file", a, b])

    rows = candidates.select("source_file", F.col(a).cast("long").alias(a), F.col(b).cast("long").alias(b), F.col(weight).cast("double").alias(weight))
    return rows.groupBy("source_file").applyInPandas(f, f"source_file string, {a} long, {b} long")


def _grams(text: Column, lengths: Column) -> Column:
    """The runs of characters of these lengths in a text."""
    runs = F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))
    return F.array_distinct(F.flatten(runs))


def located_entries(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds pdf_page to entries (source_file, entry_no, title): the page whose head has the title; null where none has.

    Entries keep their order: of all places the chain of rising pages with the most entries is taken. Entries
    that are left are then looked for with errors between the pages of those beside them, again as the chain
    that is likest in sum. The first pass meets pages on a few characters of each title, the second on gaps.
    """
    titles = entries.select("source_file", F.col("entry_no").cast("long").alias("entry_no"), normalize(F.col("title")).alias("whole"))
    titles = titles.withColumn("key", F.left("whole", F.lit(KEY))).where("key <> ''").withColumn("gram", F.left("key", F.lit(4)))
    lengths = titles.groupBy("source_file").agg(F.collect_set(F.length("gram")).alias("lengths"))
    flat = F.left(F.regexp_replace(F.coalesce("raw_text", F.lit("")), _WHITE, ""), F.lit(LONG_HEAD))
    heads = pages.join(lengths, "source_file").select("source_file", F.col("pdf_page").cast("long").alias("page"), "lengths", normalize(flat).alias("head"))
    grams = heads.select("source_file", "page", F.left("head", F.lit(HEAD)).alias("top"), "lengths")
    grams = grams.select("source_file", "page", "top", F.explode(_grams(F.col("top"), F.col("lengths"))).alias("gram"))
    exact = titles.join(grams, ["source_file", "gram"]).where(F.contains("top", F.col("key"))).withColumn("weight", F.lit(1.0))
    found = _per_file(exact, best_chain, ("entry_no", "page", "weight"))

    known = titles.join(found, ["source_file", "entry_no"], "left")
    order = Window.partitionBy("source_file").orderBy("entry_no")
    known = known.withColumn("low", F.last("page", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    known = known.withColumn("high", following_known("page", "source_file", "entry_no"))
    missed = known.where(f"page IS NULL AND length(whole) >= {LEAST_LIKE}").select("source_file", "entry_no", "whole", "low", "high")
    near = missed.join(heads, (missed["source_file"] == heads["source_file"]) & ((heads["page"] > missed["low"]) | missed["low"].isNull()) & ((heads["page"] < missed["high"]) | missed["high"].isNull()))
    near = near.select(missed["source_file"], "entry_no", "page", "whole", F.left("head", F.length("whole") + 10).alias("top"))
    near = near.where(_may_be_like(F.col("whole"), F.col("top"), LIKE)).withColumn("weight", ratio(F.col("whole"), F.col("top"))).where(F.col("weight") >= LIKE)
    more = _per_file(near, best_chain, ("entry_no", "page", "weight"))
    places = found.unionByName(more).select("source_file", "entry_no", F.col("page").alias("pdf_page"))
    return entries.join(places, ["source_file", "entry_no"], "left")


def _may_be_like(a: Column, b: Column, least: float) -> Column:
    """Whether two texts could be so much alike by their characters, whatever their order."""
    left = lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))
    return 2 * F.least(left(a, b), left(b, a)) >= least * (F.length(a) + F.length(b))


def placed_contents(entries: DataFrame, pages: DataFrame, synthesise: bool = True) -> DataFrame:
    """Contents (source_file, entry_no, kind, title, pdf_page) of dated entries.

    Bodies are located behind the contents' own pages; those not found take their printed page plus the most
    common offset of the others, if ``synthesise``. Sections take the next entry's page. What has no page, or
    goes back behind an entry before it, is left out.
    """
    span = pages.groupBy("source_file").agg(F.max("pdf_page").alias("pages"))
    ends = entries.groupBy("source_file").agg(F.max("ends_at").alias("ends_at"))
    behind = pages.join(ends, "source_file").where("pdf_page > ends_at")
    bodies = located_entries(entries.where("kind = 'body'"), behind)
    known = bodies.where("pdf_page IS NOT NULL AND page IS NOT NULL").groupBy("source_file", (F.col("pdf_page") - F.col("page")).alias("offset")).agg(F.count("*").alias("n"), F.min("entry_no").alias("first"))
    offsets = known.groupBy("source_file").agg(F.max_by("offset", F.struct("n", -F.col("first"))).alias("offset"))
    rows = entries.join(bodies.select("source_file", "entry_no", "pdf_page"), ["source_file", "entry_no"], "left").join(offsets, "source_file", "left").join(span, "source_file")
    if synthesise:
        guess = F.col("page") + F.col("offset")
        rows = rows.withColumn("pdf_page", F.coalesce("pdf_page", F.when((F.col("kind") == "body") & (guess > F.col("ends_at")) & (guess <= F.col("pages")), guess)))
    order = Window.partitionBy("source_file").orderBy("entry_no")
    following = following_known("pdf_page", "source_file", "entry_no")
    rows = rows.withColumn("pdf_page", F.when(F.col("kind") == "section", following).otherwise(F.col("pdf_page"))).where("pdf_page IS NOT NULL")
    highest = F.max("pdf_page").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("highest", highest).where("highest IS NULL OR pdf_page >= highest").select("source_file", "entry_no", "kind", "title", "pdf_page")


# -- chapters in page heads, and pairing of titles ---------------------------------------------------------


def detected_chapters(pages: DataFrame) -> DataFrame:
    """source_file, pdf_page and title of pages with a printed label that begin with a title and a date in brackets.

    A title that the chapter before has too is left out.
    """
    flat = F.regexp_replace(F.left(F.regexp_replace(F.coalesce("raw_text", F.lit("")), _WHITE, ""), F.lit(80)), r"^\d+", "")
    found = pages.where("printed_page <> ''").select("source_file", "pdf_page", flat.alias("flat"))
    found = found.withColumn("title", F.regexp_extract("flat", f"^(.*?){DATE}", 1)).where(F.length("title").between(2, 44) & ~F.col("title").rlike(NO_TITLE))
    before = F.lag("title").over(Window.partitionBy("source_file").orderBy("pdf_page"))
    return found.withColumn("before", before).where("before IS NULL OR before <> title").select("source_file", "pdf_page", "title")


def _blocks(df: DataFrame, number: str, name: str) -> DataFrame:
    """source_file, a block's number, and its rows (number, norm): about BLOCK rows of a file by their hash."""
    df = df.where("norm <> ''").select("source_file", number, "norm").distinct()
    sizes = df.groupBy("source_file").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = df.join(sizes, "source_file").withColumn(f"{name}_block", F.pmod(F.xxhash64(number), F.col("blocks")))
    return rows.groupBy("source_file", f"{name}_block").agg(F.collect_list(F.struct(F.col(number).alias("number"), "norm")).alias(name))


def _common_bits(masks: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The length of the longest common subsequence of a text (where each character stands, in bits) and others, a place a step."""
    free = np.full(places.shape[1], ~np.uint64(0))
    for codes in places:
        met = free & masks[codes]
        free = (free + met) | (free - met)
    return size - np.bitwise_count(free & np.uint64((1 << size) - 1)).astype(np.int64)


def _common(a: str, b: str) -> int:
    """The same of two texts of any length."""
    every, held = (1 << len(a)) - 1, {}
    for i, c in enumerate(a):
        held[c] = held.get(c, 0) | 1 << i
    free = every
    for c in b:
        met = free & held.get(c, 0)
        free = ((free + met) | (free - met)) & every
    return len(a) - free.bit_count()


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of a block of titles and a block of marks of at least this likeness."""
    for batch in batches:
        for row in batch.to_pylist():
            marks = [m["norm"] for m in row["marks"]]
            sizes = np.array([len(m) for m in marks])
            # characters as numbers, 0 for none; longer ones are compared one by one
            short = np.flatnonzero(sizes <= 256)
            codes = {c: i + 1 for i, c in enumerate({c for i in short for c in marks[i]})}
            places = np.zeros((int(sizes[short].max(initial=0)), len(short)), np.uint32)
            for k, i in enumerate(short):
                places[: sizes[i], k] = [codes[c] for c in marks[i]]
            out = []
            for title in row["titles"]:
                text, shared = title["norm"], np.minimum(sizes, len(title["norm"]))
                if len(text) <= 64:
                    masks = np.zeros(len(codes) + 1, np.uint64)
                    for i, c in enumerate(text):
                        if c in codes:
                            masks[codes[c]] |= np.uint64(1 << i)
                    shared[short] = _common_bits(masks, places, len(text))
                for i in np.flatnonzero(2 * shared >= least * (sizes + len(text))).tolist():
                    if (len(text) > 64 or sizes[i] > 256) and 2 * _common(text, marks[i]) < least * (sizes[i] + len(text)):
                        continue
                    likeness = difflib.SequenceMatcher(None, text, marks[i], autojunk=False).ratio()
                    if likeness >= least:
                        out.append((title["number"], row["marks"][i]["number"], likeness))
            columns = [pa.array([row["source_file"]] * len(out), pa.string()), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64())))]
            yield pa.RecordBatch.from_arrays(columns, ["source_file", "title_no", "mark_no", "likeness"])


def _candidates(titles: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """Pairs (source_file, title_no, mark_no, likeness) of titles and marks (source_file, number, norm) of at least this likeness.

    Blocks of a file's titles and marks meet in tasks. The longest common subsequence bounds the likeness, so nothing is
    lost, and only pairs within the bound are compared; no pair but those found leaves its task.
    """
    both = _blocks(titles, "title_no", "titles").join(_blocks(marks, "mark_no", "marks"), "source_file")
    both = both.repartition("source_file", "titles_block", "marks_block").select("source_file", "titles", "marks")
    return both.mapInArrow(lambda batches: _alike(batches, least), "source_file string, title_no long, mark_no long, likeness double")


def greedy_pairs(candidates: Iterable[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """(title, mark): each title in turn takes the likest mark that is left, the first of equal ones."""
    taken: set[int] = set()
    out: list[tuple[int, int]] = []
    for title, mark, _ in sorted(candidates, key=lambda c: (c[0], -c[2], c[1])):
        if mark not in taken and (not out or out[-1][0] != title):
            taken.add(mark)
            out.append((title, mark))
    return out


def likest_pairs(candidates: Iterable[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """(title, mark): the likest pair of all that are left comes next, so that no title takes a mark from one that is more like it."""
    titles: set[int] = set()
    marks: set[int] = set()
    out: list[tuple[int, int]] = []
    for title, mark, _ in sorted(candidates, key=lambda c: (-c[2], c[0], c[1])):
        if title not in titles and mark not in marks:
            titles.add(title)
            marks.add(mark)
            out.append((title, mark))
    return out


def paired_titles(titles: DataFrame, marks: DataFrame, least: float = LIKE, likest_first: bool = False) -> DataFrame:
    """(source_file, title_no, mark_no): titles of a file paired with its marks one to one, as greedy_pairs() does.

    In the order of titles, one whose own mark is missing may take that of a later title by a chance likeness;
    ``likest_first`` pairs as likest_pairs() does.
    """
    named = lambda df, number: df.select("source_file", F.col(number).cast("long").alias(number), normalize(F.col("title")).alias("norm"))
    found = _candidates(named(titles, "title_no"), named(marks, "mark_no"), least)
    return _per_file(found, likest_pairs if likest_first else greedy_pairs, ("title_no", "mark_no", "likeness"))


def merged_contents(detected: DataFrame, printed: DataFrame, pages: DataFrame, least: float = 0.75) -> DataFrame:
    """Detected chapters (source_file, pdf_page, title), and those only printed in contents (source_file, title_no, title).

    A printed title is the first detected chapter left whose title holds it, is held by it or is at least so
    like it. Titles that no chapter matches are looked for in the heads of labelled pages between the chapters of
    the titles beside them. origin tells which is which.
    """
    number = F.row_number().over(Window.partitionBy("source_file").orderBy("pdf_page"))
    det = detected.withColumn("mark_no", number.cast("long"))
    a = printed.select("source_file", F.col("title_no").cast("long").alias("title_no"), normalize(F.col("title")).alias("norm")).where("norm <> ''")
    b = det.select("source_file", "mark_no", normalize(F.col("title")).alias("norm")).where("norm <> ''")
    like = _candidates(a, b, least).select("source_file", "title_no", "mark_no")
    held = a.withColumnRenamed("norm", "a").join(b.withColumnRenamed("norm", "b"), "source_file").where(F.contains("a", F.col("b")) | F.contains("b", F.col("a")))
    # the first in the order of pages counts, not the likest
    both = like.unionByName(held.select("source_file", "title_no", "mark_no")).distinct().withColumn("likeness", F.lit(1.0))
    pairs = _per_file(both, greedy_pairs, ("title_no", "mark_no", "likeness"))
    known = printed.join(pairs, ["source_file", "title_no"], "left").join(det.select("source_file", "mark_no", F.col("pdf_page").cast("long").alias("page")), ["source_file", "mark_no"], "left")
    order = Window.partitionBy("source_file").orderBy("title_no")
    known = known.withColumn("low", F.last("page", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    known = known.withColumn("high", following_known("page", "source_file", "title_no"))
    missed = known.where("mark_no IS NULL").select("source_file", "title_no", "title", F.left(normalize(F.col("title")), F.lit(10)).alias("key"), "low", "high").where("key <> ''")
    flat = F.left(F.regexp_replace(F.coalesce("raw_text", F.lit("")), _WHITE, ""), F.lit(70))
    heads = pages.where("printed_page <> ''").select(F.col("source_file").alias("file"), F.col("pdf_page").cast("long").alias("at"), F.left(normalize(flat), F.lit(44)).alias("head"))
    within = "file = source_file AND (low IS NULL OR at > low) AND (high IS NULL OR at < high)"
    found = missed.join(heads, F.expr(within) & F.contains("head", F.col("key"))).withColumn("weight", F.lit(1.0))
    added = _per_file(found, best_chain, ("title_no", "at", "weight")).join(missed.select("source_file", "title_no", "title"), ["source_file", "title_no"])
    out = detected.select("source_file", F.col("pdf_page").cast("long").alias("pdf_page"), "title", F.lit("detected").alias("origin"))
    return out.unionByName(added.select("source_file", F.col("at").alias("pdf_page"), "title", F.lit("printed").alias("origin")))
