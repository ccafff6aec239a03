"""A dictionary from its pages: the index of its headings, where they stand, their texts, glosses and what needs review.

Pages have source_file (a dictionary), page (the printed number) and text. Headings meet lines on a page and a key that
both must share (a first character, a name after a dot, the characters before a bracket), never by trying all of them. All
sides grow with the pages, so joins are merge joins: no table is sent to every executor for being small when compressed.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import accumulate
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from folia.functions.fields import dictionary_norm
from folia.functions.text import WHITE, let, nfkc, quoted, trimmed
from folia.session import written

# Pages an entry may take, lines a heading may take, the longest title, the tail of the page before.
MOST_PAGES, HEADING_LINES, MOST_TITLE, TAIL = 8, 4, 80, 12
# Headings of so many characters may have one wrong one; contents shorter than this are short.
LEAST_TYPO, LEAST_CONTENT, MOST_CITED = 10, 60, 0.78
# Leaders, Chinese characters, brackets at a heading's end, and what the comparison of headings leaves out.
LEADERS, HAN, CLOSERS = "[⋯·.。．]", "一-鿿", "》〉>)）”\""
IGNORED = WHITE[1:-1] + "《》〈〉<>()（）“”‘’\"'\\[\\]【】，、。；：！？—–·・•…"
# Lines that belong to no entry; {} is the dictionary's name.
NOISE = (r"^(?:\d+\s*)?{}$", r"^{}\d{{1,4}}$", r"^\d{{1,4}}$", r"^第[一二三四五六七八九十]+编", r"词目拼音索引", r"^目录$", rf"^[一二三四五六七八九十]+、[{HAN}]{{{{2,12}}}}$")
# What a paragraph's text is mended by, in order; the second part only where ?? is left by the first.
MENDS = (
    ("[�□■◆◇]|⋯{2,}|­", ""),
    (rf"(?<=[，。；：！？、]){WHITE}+|{WHITE}+(?=[，。；：！？、])", ""),
    (rf"(?<=[{HAN}]){WHITE}+(?=[{HAN}])", ""),
    (rf"(?<=[A-Za-z])-{WHITE}+(?=[A-Za-z])", ""),
)
QUESTIONS = ((r"(?<=\d)\?\?(?=\d)", "%—"), (r"(?<=\d)\?\?", "%"), (r"\?\?", ""))
PUNCTUATION = (*((rf"(?<=[{HAN}”]){WHITE}*{a}{WHITE}*(?=[{HAN}“])", b) for a, b in ((",", "，"), (";", "；"), (":", "："))), *((rf"(?<=[{HAN}”]){WHITE}*{a}{WHITE}*", b) for a, b in (("!", "！"), (r"\?", "？"))), (rf"{WHITE}{{2,}}", " "))
# Words that scanning often gets wrong.
WRONG = {"马思主义": "马克思主义", "马克恩": "马克思", "恩格期": "恩格斯", "列宇": "列宁", "毛泽乐": "毛泽东", "中因": "中国", "社会主文": "社会主义", "共产主文": "共产主义"}
# A reference to another entry, issues that call for review, letters of a gloss and where it may begin.
REFERENCE = rf"(?Us)^(?:.{{0,40}}?[☆★])?{WHITE}*参见{WHITE}*\d{{1,4}}{WHITE}*页"
REVIEWED = ("title_not_found", "noise_residue", "long_entry_capped", "short_content", "title_bracket_unbalanced")
LEAST_LATIN, LAST_GLOSS = 0.7, 48

_DIGITS, _LATIN = "0-9０-９", "[A-Za-z]{2}"
_ORDER = ("source_file", "page", "line_no")


# -- functions on columns ------------------------------------------------------------------------------


def _all(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, "(?U)" + r[0], r[1]), rules, text)


def core(title: Column) -> Column:
    """A title without white space, brackets, quotes and stops."""
    return F.regexp_replace(title, f"(?U)[{IGNORED}]+", "")


def polished(text: Column) -> Column:
    """(text, issues): paragraphs in NFKC, blanks and stops mended, and words that scanning gets wrong put right.

    Null and empty texts give an empty text without issues. Issues come in no order.
    """
    first = F.transform(F.split(nfkc(F.coalesce(text, F.lit(""))), "\n\n"), lambda p: _all(p, MENDS))

    def mended(paragraphs: Column) -> Column:
        rest = F.transform(paragraphs, lambda p: trimmed(_all(_all(p, QUESTIONS), PUNCTUATION)))
        whole = F.array_join(F.filter(rest, lambda p: p != ""), "\n\n")
        return F.struct(whole.alias("text"), F.exists(paragraphs, lambda p: F.contains(p, F.lit("??"))).alias("asked"))

    def righted(found: Column) -> Column:
        # one step after another, as one mended word may hold the next wrong one
        steps = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(r).alias("r")) for w, r in WRONG.items()])
        start = F.struct(found["text"].alias("text"), F.when(found["asked"], F.array(F.lit("auto_fix:question_marks"))).otherwise(F.array().cast("array<string>")).alias("issues"))
        step = lambda acc, s: F.when(
            F.contains(acc["text"], s["w"]),
            F.struct(F.replace(acc["text"], s["w"], s["r"]).alias("text"), F.concat(acc["issues"], F.array(F.concat(F.lit("auto_fix:"), s["w"], F.lit("->"), s["r"]))).alias("issues")),
        ).otherwise(acc)
        return F.aggregate(steps, start, step)

    return let(let(first, mended), righted)


def _gloss(text: str) -> tuple[str, str]:
    opening = re.compile(r"[(（]")
    at = 0
    while (found := opening.search(text, at)) and found.start() <= LAST_GLOSS:
        begin = found.start()
        # a gloss goes no further than the next Chinese character
        span = re.compile(f"[^{HAN}]*").match(text, begin)[0]
        levels = accumulate((c in "(（") - (c in ")）") for c in span)
        size = next((i for i, level in enumerate(levels, 1) if level == 0), 0) or 1 + max(map(span.rfind, ")）〕]"))
        inner = span[1 : max(size - 1, 1)].strip()
        latin = sum(ord(c) < 0x2E80 for c in inner)
        if size > 1 and re.search(_LATIN, inner) and latin >= LEAST_LATIN * len(inner):
            gloss = " ".join(inner.split()).strip(" 〔〕[]")
            gloss += ")" * (gloss.count("(") == gloss.count(")") + 1)
            return gloss, (text[:begin] + text[begin + size :]).strip()
        at = begin + max(size, 1)
    return "", text


@F.pandas_udf(StructType().add("gloss", StringType()).add("text", StringType()))
def gloss(texts: pd.Series) -> pd.DataFrame:
    """(gloss, text): the foreign name in brackets near a text's start, however nested, and the text without it."""
    return pd.DataFrame([_gloss(t or "") for t in texts], columns=["gloss", "text"])


def _brackets(title: str) -> tuple[str, bool]:
    marks, open_, sides = list(title), [], dict(zip("》〉>)）", "《〈<(（", strict=True))
    for i, c in enumerate(title):
        if c in sides.values():
            open_.append(i)
        elif c in sides:
            if not open_:
                return title, False
            j = open_.pop()
            pair, round_ = title[j] + c, title[j] in "(（" and c in ")）"
            fits = round_ and (title[j] == "(") == (c == ")") or not round_ and sides[c] == title[j]
            if open_ and not (fits and round_):
                # what stands within other brackets is a title within a title
                marks[j], marks[i] = "〈〉"
            elif not open_ and not fits:
                marks[j], marks[i] = "《》" if set(pair) & set("《》") else "()" if set(pair) & set("(（)）") else "〈〉"
    return ("".join(marks), True) if not open_ else (title, False)


@F.pandas_udf(StructType().add("title", StringType()).add("balanced", BooleanType()))
def brackets(titles: pd.Series) -> pd.DataFrame:
    """(title, balanced): brackets in pairs of one kind, inner ones angle brackets; as it was where they don't pair."""
    return pd.DataFrame([_brackets(t or "") for t in titles], columns=["title", "balanced"])


# -- index and lines -----------------------------------------------------------------------------------


def page_lines(pages: DataFrame) -> DataFrame:
    """source_file, page, line_no, text and para (whether it is set in by two blanks) of every line that isn't blank."""
    rows = pages.select("source_file", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n|\r")).alias("line_no", "raw"))
    rows = rows.select(*_ORDER, trimmed("raw").alias("text"), F.col("raw").rlike(r"^(?:　| {2}|\t)").alias("para"))
    return rows.where("text != ''")


def printed_pages(pages: DataFrame, source_file: str, parts: list[tuple[str, int, int, int]]) -> DataFrame:
    """Pages of volumes (source_file, pdf_page, text) as pages of one dictionary by their printed numbers.

    A part is (volume, first and last printed page, pages in front); pages outside all parts go.
    """
    printed = [F.when((F.col("source_file") == v) & (F.col("pdf_page") - front).between(first, last), F.col("pdf_page") - front) for v, first, last, front in parts]
    return pages.select(F.lit(source_file).alias("source_file"), F.coalesce(*printed).cast("int").alias("page"), "text").where("page IS NOT NULL")


def index_entries(index: DataFrame, name: str, last_page: int = 9999, notes: tuple[str, ...] = ()) -> DataFrame:
    """source_file, title, letter, start_page and sort_order of the entries that index pages list.

    A title goes on over lines until a page number ends it, at the line's end or on a line of its own (from 2 to last_page);
    a letter on a line of its own begins a group and drops what is open. Lines with a note's words are passed over. Of equal
    titles of one page the first stays. No entry: titles that are empty or over 80 characters.
    """
    line, w = F.col("text"), Window.partitionBy("source_file").orderBy("page", "line_no")
    paged = rf"(?U)^(.*?)(?:{LEADERS}|{WHITE})+([{_DIGITS}]{{1,4}})(?:[、,，]\d{{1,4}})?$"
    number = lambda text: F.translate(text, "０１２３４５６７８９", "0123456789").cast("int")
    header = line.rlike(rf"(?U)^(?:\d+{WHITE}*)?{quoted(name)}$|^词目拼音索引(?:{WHITE}+\d+)?$|^第[一二三四五六七八九十]+编")
    noted = reduce(or_, [F.contains(line, F.lit(n)) for n in notes], F.lit(False))
    alone = line.rlike(f"^[{_DIGITS}]{{1,4}}$")
    kind = F.when(alone, F.when(number(line).between(2, last_page), "number")).when(header | noted, None).when(line.rlike("^[A-Z]$"), "letter").when(line.rlike(paged), "paged").when(~line.rlike(f"^{LEADERS}{{2,}}$"), "title")
    rows = page_lines(index).withColumn("kind", kind).where("kind IS NOT NULL")
    ends = F.when(F.col("kind") != "title", 1)
    rows = rows.withColumn("part", F.count(ends).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("letter", F.last(F.when(F.col("kind") == "letter", line), True).over(w))
    piece = F.when(F.col("kind") == "title", line).when(F.col("kind") == "paged", F.regexp_extract(line, paged, 1))
    # of lines of one part only the last ends it
    parts = rows.groupBy("source_file", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("page", "line_no", piece.alias("piece"))))), lambda x: x["piece"]), "").alias("title"),
        F.max(F.when(F.col("kind") == "number", number(line)).when(F.col("kind") == "paged", number(F.regexp_extract(line, paged, 2)))).alias("start_page"),
        F.max("letter").alias("letter"),
    )
    title = F.regexp_replace(F.regexp_replace("title", f"{LEADERS}{{2,}}", ""), f"(?U){WHITE}+", "")
    parts = parts.where("start_page IS NOT NULL").withColumn("title", title).where(F.length("title").between(1, MOST_TITLE))
    parts = parts.withColumn("sort_order", F.row_number().over(Window.partitionBy("source_file").orderBy("part")))
    firsts = parts.groupBy("source_file", "title", "start_page").agg(F.min("sort_order").alias("sort_order"), F.min_by("letter", "sort_order").alias("letter"))
    return firsts.select("source_file", "title", F.coalesce("letter", F.lit("#")).alias("letter"), "start_page", "sort_order")


def body_lines(pages: DataFrame, name: str) -> DataFrame:
    """Lines that may belong to entries, with their place in the dictionary (pos) and page (nth of held), and the lines ahead."""
    compact = F.regexp_replace("text", f"(?U){WHITE}+", "")
    noise = [compact.rlike("(?U)" + n.format(quoted(name))) for n in NOISE]
    rows = page_lines(pages).where(~reduce(or_, noise)).withColumn("compact", compact)
    w, on_page = Window.partitionBy("source_file").orderBy("page", "line_no"), Window.partitionBy("source_file", "page")
    rows = rows.withColumn("pos", F.row_number().over(w)).withColumn("nth", F.row_number().over(on_page.orderBy("line_no")) - 1).withColumn("held", F.count("*").over(on_page))
    ahead = F.concat_ws("\n", "text", *[F.lead("text", i).over(w) for i in range(1, HEADING_LINES)])
    return rows.withColumns({"ahead": ahead, "beyond": F.lead("text", HEADING_LINES).over(w)}).withColumn("ahead_core", core(F.col("ahead")))


# -- headings ------------------------------------------------------------------------------------------


def _foreign(text: Column) -> Column:
    """Whether a text begins with a bracket and soon has letters."""
    return text.rlike("^[(（]") & F.left(text, F.lit(90)).rlike(_LATIN)


def _at_line_start(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """Titles at the start of a line, over up to four lines; a long one may have a wrong character, but at its ends."""
    rows = wanted.join(lines.withColumn("key", F.left("ahead_core", F.lit(1))).hint("merge"), ["source_file", "page", "key"])
    n, seen = F.length("core"), F.left("ahead_core", F.length("core"))
    han = f"^[{HAN}]$"
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(seen, i, F.lit(1)) != F.substring("core", i, F.lit(1)))
    one = let(differ, lambda d: (F.size(d) == 1) & ~F.get(d, F.lit(0)).isin(1) & (F.get(d, F.lit(0)) != n) & F.substring(seen, F.get(d, F.lit(0)), F.lit(1)).rlike(han) & F.substring("core", F.get(d, F.lit(0)), F.lit(1)).rlike(han))
    rows = rows.where((F.length(seen) == n) & ((seen == F.col("core")) | F.when(n >= LEAST_TYPO, one).otherwise(False)))
    rows = rows.withColumn("head", F.regexp_substr("ahead", F.concat(F.lit(f"(?U)^(?:[{IGNORED}]*[^{IGNORED}]){{"), n.cast("string"), F.lit("}"))))
    tail = F.substring("ahead", F.length("head") + 1, F.length("ahead"))
    rows = rows.withColumn("closed", F.regexp_extract(tail, f"(?U)^[{CLOSERS}{WHITE[1:-1]}&&[^\\n]]*", 0))
    rows = rows.withColumn("after", F.split(F.substring("ahead", F.length("head") + F.length("closed") + 1, F.length("ahead")), "\n"))
    steps, rest = F.size(F.split("head", "\n")) - 1, trimmed(F.get("after", F.lit(0)))
    following = F.coalesce(F.get("after", F.lit(1)), F.when(steps == HEADING_LINES - 1, F.col("beyond")), F.lit(""))
    rows = rows.withColumns({"rest": rest, "starts": F.col("pos") + steps + F.when(rest == "", 1).otherwise(0)})
    rows = rows.where((F.col("rest") == "") | F.col("rest").rlike(r"^[(（☆\x00-\x7f]"))
    marked = F.regexp_extract("head", f"(?U)^[{IGNORED}]*", 0).contains("《") & F.col("closed").rlike(f"[{CLOSERS}]")
    return rows.select("source_file", "entry", "title", "start_page", "page", "pos", "nth", "held", F.lit(0).alias("kind"), "starts", "rest", marked.alias("marked"), F.when(F.col("rest") == "", _foreign(following)).otherwise(_foreign(F.col("rest"))).alias("foreign"))


def _persons(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """Family names after the dot of a whole name with a foreign name in brackets, in the line or the next."""
    rows = lines.withColumn("key", F.explode(F.array_distinct(F.regexp_extract_all("compact", F.lit(rf"[·・•]([{HAN}]{{2,8}})(?=[(（]|$)"), 1))))
    rows = wanted.withColumn("key", F.col("title")).join(rows.hint("merge"), ["source_file", "page", "key"])
    following = F.coalesce(F.get(F.split("ahead", "\n"), F.lit(1)), F.lit(""))

    def named(dot: str) -> Column:
        at = F.instr("compact", F.concat(F.lit(dot), "title"))
        after = F.substring("compact", at + 1 + F.length("title"), F.length("compact"))
        inside = after.rlike(r"^[(（][^)）]*[)）](?:[(（]|$)") | (after.rlike(r"^[(（][^)）]*$") & after.rlike(_LATIN))
        return at.between(1, 21) & F.when(after == "", following.rlike("^[(（]") & following.rlike(_LATIN)).otherwise(inside)

    rows = rows.where(reduce(or_, [named(d) for d in "·・•"]))
    return rows.select("source_file", "entry", "title", "start_page", "page", "pos", "nth", "held", F.lit(1).alias("kind"), F.col("pos").alias("starts"), F.lit("").alias("rest"), F.lit(False).alias("marked"), F.lit(True).alias("foreign"))


def _within_lines(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """Titles of three characters and more within the first of a line, before a bracket."""
    plain = F.regexp_replace("title", f"(?U){WHITE}+", "")
    rows = lines.withColumn("key", F.explode(F.array_distinct(F.regexp_extract_all("compact", F.lit("(?<=(.{3}))[(（]"), 1))))
    rows = wanted.withColumn("plain", plain).where(F.length("plain") >= 3).withColumn("key", F.right("plain", F.lit(3))).join(rows.hint("merge"), ["source_file", "page", "key"])
    at = F.instr("compact", F.col("plain"))
    size = at - 1 + F.length("plain")
    rows = rows.where(at.between(2, 25) & F.substring("compact", size + 1, F.lit(1)).isin("(", "（"))
    head = F.regexp_substr("text", F.concat(F.lit(f"(?U)^(?:{WHITE}*[^{WHITE[1:-1]}]){{"), size.cast("string"), F.lit("}")))
    rest = trimmed(F.substring("text", F.length(head) + 1, F.length("text")))
    return rows.select("source_file", "entry", "title", "start_page", "page", "pos", "nth", "held", F.lit(2).alias("kind"), F.col("pos").alias("starts"), rest.alias("rest"), F.lit(False).alias("marked"), _foreign(rest).alias("foreign"))


def headings(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Every line where an entry's title stands, from the page before its own to the last that it may take."""
    pages = F.explode(F.sequence(F.col("start_page") - 1, F.col("start_page") + MOST_PAGES)).alias("page")
    wanted = entries.select("source_file", F.col("sort_order").alias("entry"), "title", "start_page", core(F.col("title")).alias("core"), pages)
    by_core = wanted.where("core != ''").withColumn("key", F.left("core", F.lit(1)))
    persons = wanted.where(F.col("title").rlike(f"^[{HAN}]{{2,8}}$"))
    return _at_line_start(by_core, lines).unionByName(_persons(persons, lines)).unionByName(_within_lines(wanted, lines))


def _starts(entries: DataFrame, lines: DataFrame, found: DataFrame) -> DataFrame:
    """Where each entry's text begins: after its title, one with a foreign name first; else at the first paragraph."""
    own = ["source_file", "entry"]
    # a line counts once for an entry: as its start, else as a name, else within
    first = found.groupBy(*own, "pos").agg(F.min_by(F.struct(*[c for c in found.columns if c not in ("source_file", "entry")]), "kind").alias("m"))
    best = lambda here: F.min_by(F.when(here, F.col("m")), F.when(here, F.struct(~F.col("m.foreign"), F.col("pos"))))
    chosen = first.groupBy(*own).agg(best(F.col("m.page") >= F.col("m.start_page")).alias("here"), best(F.col("m.page") < F.col("m.start_page")).alias("before"))
    late = F.col("before.nth") + F.col("before.starts") - F.col("before.pos") >= F.col("before.held") - TAIL
    chosen = chosen.select(*own, F.coalesce("here", F.when(late & (F.col("before.start_page") > 2), F.col("before"))).alias("m")).where("m IS NOT NULL")
    rows = entries.withColumnRenamed("sort_order", "entry").join(chosen.hint("merge"), own, "left")
    # of entries without a title only those lines are looked at that their pages hold
    lost = rows.where("m IS NULL").select(*own, F.explode(F.sequence(F.col("start_page"), F.col("start_page") + MOST_PAGES)).alias("page"))
    heads = lines.groupBy("source_file", "page").agg(F.min("pos").alias("first"), F.min(F.when(F.col("para"), F.col("pos"))).alias("para"))
    lost = lost.join(heads.hint("merge"), ["source_file", "page"]).groupBy(*own).agg(F.coalesce(F.min("para"), F.min("first")).alias("lost"))
    rows = rows.join(lost.hint("merge"), own, "left")
    return rows.select(*own, "title", "letter", "start_page", F.coalesce("m.starts", "lost").alias("starts"), F.coalesce("m.page", "start_page").alias("from_page"), F.nullif("m.rest", F.lit("")).alias("rest"), F.col("m").isNotNull().alias("found"), F.coalesce("m.marked", F.lit(False)).alias("marked"))


def _joined(lines: Column) -> Column:
    """Lines as paragraphs: words cut by a hyphen are put together, blanks stand between words of letters and digits only."""
    tidy = F.transform(lines, lambda x: F.struct(trimmed(F.regexp_replace(F.regexp_replace(x["text"], f"(?U)(?<=[{HAN}]){WHITE}+(?=[{HAN}])", ""), f"(?U){WHITE}+", " ")).alias("text"), x["para"].alias("para")))

    def add(text: Column, x: Column) -> Column:
        cut = F.right(text, F.lit(2)).rlike("^[A-Za-z]-$") & x["text"].rlike("^[A-Za-z]")
        words = F.right(text, F.lit(1)).rlike("[A-Za-z0-9]") & x["text"].rlike("^[A-Za-z0-9]")
        between = F.when(text == "", "").when(x["para"], "\n\n").when(words, " ").otherwise("")
        return F.when(cut & ~x["para"], F.concat(F.left(text, F.length(text) - 1), x["text"])).otherwise(F.concat(text, between, x["text"]))

    return F.aggregate(F.filter(tidy, lambda x: x["text"] != ""), F.lit(""), add)


# -- entries -------------------------------------------------------------------------------------------


def build_dictionary(index: DataFrame, pages: DataFrame, name: str, cited: str = "", last_page: int = 9999, notes: tuple[str, ...] = ()) -> DataFrame:
    """The entries of dictionaries: slug, titles, gloss, content, pages, citation, confidence and what needs review.

    index and pages: source_file, page (printed), text, null texts being empty. An entry goes from its title to the next
    title of its pages, over eight pages after its own at most. Entries whose title isn't found begin at their page's first
    paragraph; without any line they are empty. issues are sorted. Slugs are numbered from 2 where title and page agree.
    Lines, entries, headings and starts are written once and read where they are needed.
    """
    lines = written(body_lines(pages.where(F.col("page").between(2, last_page)), name))
    entries = written(index_entries(index, name, last_page, notes))
    found = written(headings(entries, lines))
    starts, own = written(_starts(entries, lines, found)), ["source_file", "entry"]
    spans = starts.withColumn("page", F.explode(F.sequence(F.col("from_page"), F.col("start_page") + MOST_PAGES)))
    heads = found.where("page = start_page AND (kind = 0 AND foreign OR kind = 1)").select("source_file", "page", F.col("pos").alias("head"), F.col("title").alias("other")).distinct()
    nexts = spans.where("page >= start_page").join(heads.hint("merge"), ["source_file", "page"]).where("head > starts AND other != title").groupBy(*own).agg(F.min("head").alias("next"))
    held = spans.join(nexts.hint("merge"), own, "left").join(lines.select("source_file", "page", "pos", "text", "para").hint("merge"), ["source_file", "page"]).where("pos >= starts AND (next IS NULL OR pos < next)")
    text = F.when((F.col("pos") == F.col("starts")) & F.col("rest").isNotNull(), F.col("rest")).otherwise(F.col("text"))
    line = F.struct("pos", text.alias("text"), (F.col("para") | (F.col("pos") == F.col("starts")) & F.col("found")).alias("para"))
    contents = held.groupBy(*own).agg(F.array_sort(F.collect_list(line)).alias("lines"), F.max("page").alias("end_page"))
    rows = starts.join(nexts.hint("merge"), own, "left").join(contents.hint("merge"), own, "left").withColumn("end_page", F.coalesce("end_page", "start_page"))
    rows = rows.withColumn("mended", polished(_joined(F.coalesce("lines", F.array().cast("array<struct<pos:int,text:string,para:boolean>>")))))
    rows = rows.withColumn("named", gloss(F.col("mended.text")))
    given = F.when(F.col("marked") & ~F.startswith("title", F.lit("《")), F.concat(F.lit("《"), "title", F.lit("》"))).otherwise(F.col("title"))
    rows = rows.withColumn("given", given).withColumn("fixed", brackets(F.col("given")))
    content, whole = F.col("named.text"), F.col("mended.text")
    issue = lambda condition, name: F.when(condition, F.lit(name))
    own_issues = F.array(
        issue(~F.col("found"), "title_not_found"),
        issue(F.col("next").isNull(), "next_heading_not_found"),
        issue(whole.rlike("[A-Za-z]{18,}"), "long_latin_run"),
        issue(whole.rlike("⋯⋯|词目拼音索引") | F.left(whole, F.lit(40)).contains(name), "noise_residue"),
        issue(content.rlike(REFERENCE), "cross_reference"),
        issue(~content.rlike(REFERENCE) & (F.length(content) < LEAST_CONTENT), "short_content"),
        issue(F.col("next").isNull() & (F.col("end_page") >= F.col("start_page") + MOST_PAGES), "long_entry_capped"),
    )
    # an unpaired bracket is known only after confidence was set
    before = F.concat(F.array_compact(own_issues), F.col("mended.issues"))
    sure = F.least(F.lit(0.99), F.lit(0.55) + F.when(F.col("found"), 0.25).otherwise(0.0) + F.when(F.col("next").isNotNull(), 0.15).otherwise(0.0))
    issues = F.array_sort(F.array_distinct(F.concat(before, F.array_compact(F.array(issue(~F.col("fixed.balanced"), "title_bracket_unbalanced"))))))
    rows = rows.withColumns({"confidence": F.when(F.size(before) > 0, F.least(sure, F.lit(MOST_CITED))).otherwise(sure), "issues": issues})
    base = F.lower(F.regexp_replace(F.regexp_replace("fixed.title", f"[^0-9A-Za-z{HAN}]+", "-"), "^-+|-+$", ""))
    slug = F.concat_ws("-", F.when(base == "", "entry").otherwise(base), "start_page")
    rows = rows.withColumn("base", slug).withColumn("n", F.row_number().over(Window.partitionBy("source_file", "base").orderBy("entry")))
    printed = F.when(F.col("start_page") == F.col("end_page"), F.col("start_page").cast("string")).otherwise(F.concat_ws("-", "start_page", "end_page"))
    return rows.select(
        "source_file", F.col("entry").alias("sort_order"), F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "n")).alias("slug"),
        F.col("fixed.title").alias("title"), F.col("title").alias("index_title"), dictionary_norm(F.col("fixed.title")).alias("norm_title"), "letter",
        F.col("named.gloss").alias("english"), content.alias("content"), "start_page", "end_page", F.concat(F.lit(cited), F.lit("第 "), printed, F.lit(" 页。")).alias("citation"),
        "confidence", F.arrays_overlap("issues", F.array(*map(F.lit, REVIEWED))).alias("needs_review"), "issues",
    )


def dictionary_report(entries: DataFrame) -> DataFrame:
    """Entries, entries to review, with a gloss and with a title that was changed, of each dictionary."""
    return entries.groupBy("source_file").agg(F.count("*").alias("entries"), F.count_if("needs_review").alias("to_review"), F.count_if(F.col("english") != "").alias("glosses"), F.count_if(F.col("title") != F.col("index_title")).alias("title_changes"))
