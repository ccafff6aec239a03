"""Corpus preparation: corrections, page-number gaps, bigrams, substitution tiers, offsets and monotone repair."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.text import disjoint_count, trimmed
from folia.functions.windows import following_known


def fill_printed_pages(pages: DataFrame) -> DataFrame:
    """Adds filled: missing printed numbers between known ones of the same file.

    A gap is filled if the numbers on its sides differ as the pages do; else, if they differ by one more
    than the gap's pages with text, those are numbered and blank ones stay without. Gaps at a file's ends
    and roman labels stay.
    """
    order = Window.partitionBy("source_file").orderBy("pdf_page")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    number = F.expr("try_cast(printed_page AS INT)")
    known = F.when(number.isNotNull(), F.struct(F.col("pdf_page").alias("at"), number.alias("number"), F.col("__texts").alias("texts")))
    rows = pages.withColumn("__text", (F.length(trimmed("raw_text")) > 0).cast("int"))
    rows = rows.withColumn("__texts", F.sum("__text").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__k", known)
    rows = rows.withColumn("__a", F.last("__k", ignorenulls=True).over(before)).withColumn("__b", following_known("__k", "source_file", "pdf_page"))
    delta = F.col("__b.number") - F.col("__a.number")
    strict = delta == F.col("__b.at") - F.col("__a.at")
    # pages with text strictly between the neighbours
    inside = F.col("__b.texts") - F.col("__a.texts") - F.expr("CASE WHEN __b.at IS NULL THEN 0 ELSE __b_text END")
    rows = rows.withColumn("__kt", F.when(number.isNotNull(), F.col("__text"))).withColumn("__b_text", following_known("__kt", "source_file", "pdf_page"))
    loose = (delta == inside + 1) & (F.col("__text") == 1)
    filled = F.when(number.isNotNull() | F.col("printed_page").isNotNull(), F.col("printed_page"))
    filled = filled.when(strict, (F.col("__a.number") + F.col("pdf_page") - F.col("__a.at")).cast("string"))
    filled = filled.when(loose, (F.col("__a.number") + F.col("__texts") - F.col("__a.texts")).cast("string"))
    return rows.withColumn("filled", filled).select(*pages.columns, "filled")


def bigrams(pages: DataFrame, pattern: str = r"\p{IsHan}+") -> DataFrame:
    """How often two characters follow one another in runs that match a pattern."""
    runs = pages.select(F.explode(F.regexp_extract_all("raw_text", F.lit(pattern), F.lit(0))).alias("run")).where("length(run) > 1")
    pairs = runs.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - 1), lambda i: F.substring("run", i, F.lit(2)))).alias("bigram"))
    return pairs.groupBy("bigram").agg(F.count("*").alias("n"))


def pair_tiers(pairs: DataFrame) -> DataFrame:
    """Substitution pairs (ocr, auth) with their number and tier: from 4 high, from 2 mid, else low."""
    counted = pairs.groupBy("ocr", "auth").agg(F.count("*").alias("n"))
    return counted.withColumn("tier", F.when(F.col("n") >= 4, "high").when(F.col("n") >= 2, "mid").otherwise("low"))


def page_offsets(pages: DataFrame, least: int = 20, share: float = 0.6) -> DataFrame:
    """The most common offset of printed to file pages of each file, and whether enough pages support it."""
    number = F.expr("try_cast(printed_page AS INT)")
    rows = pages.where(number.isNotNull()).groupBy("source_file", (number - F.col("pdf_page")).alias("offset")).agg(F.count("*").alias("n"))
    best = rows.groupBy("source_file").agg(F.max_by("offset", F.struct("n", -F.col("offset"))).alias("offset"), F.max("n").alias("support"), F.sum("n").alias("pages"))
    return best.withColumn("trusted", F.col("support") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share)))


def monotone_entries(entries: DataFrame) -> DataFrame:
    """Entries whose page does not go back behind one before them (by sort_order, then page)."""
    highest = F.max("pdf_page").over(Window.partitionBy("source_file").orderBy("sort_order", "pdf_page").rowsBetween(Window.unboundedPreceding, -1))
    return entries.withColumn("__h", highest).where("__h IS NULL OR pdf_page >= __h").drop("__h")


def longest_non_decreasing(entries: DataFrame) -> DataFrame:
    """kept: whether an entry is in the longest non-decreasing run of pages of its file, by patience sorting.

    A file's table of contents is short; each is one group.
    """
    from bisect import bisect_right

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sort_order", kind="stable")
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for i, page in enumerate(frame["pdf_page"]):
            at = bisect_right(tails, page)
            back.append(ends[at - 1] if at else -1)
            tails[at : at + 1] = [page]
            ends[at : at + 1] = [i]
        kept, i = [False] * len(frame), ends[-1] if ends else -1
        while i >= 0:
            kept[i], i = True, back[i]
        return frame.assign(kept=kept)

    return entries.select("source_file", "sort_order", "pdf_page").groupBy("source_file").applyInPandas(f, "source_file string, sort_order int, pdf_page int, kept boolean")


def interpolated(rows: DataFrame) -> DataFrame:
    """Adds page: known ones, and those between two known ones on a line, rounded half to even."""
    order = Window.partitionBy("source_file").orderBy("sort_order")
    known = F.when(F.col("known").isNotNull(), F.struct("sort_order", "known"))
    out = rows.withColumn("__k", known)
    out = out.withColumn("__a", F.last("__k", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__b", following_known("__k", "source_file", "sort_order", own=True))
    line = F.col("__a.known") + F.bround((F.col("__b.known") - F.col("__a.known")) * (F.col("sort_order") - F.col("__a.sort_order")) / (F.col("__b.sort_order") - F.col("__a.sort_order")))
    return out.withColumn("page", F.coalesce("known", line.cast("int"))).drop("__k", "__a", "__b")


def aligned_substitutions(pairs: DataFrame) -> DataFrame:
    """Substitutions of at most two characters between two readings of a page, with three characters about them."""
    from difflib import SequenceMatcher

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, page, ocr, auth in zip(frame["source_file"], frame["pdf_page"], frame["ocr"], frame["auth"], strict=True):
                for tag, a, b, c, d in SequenceMatcher(None, ocr or "", auth or "", autojunk=False).get_opcodes():
                    if tag == "replace" and b - a == d - c <= 2:
                        rows.append((file, page, ocr[a:b], auth[c:d], ocr[max(0, a - 3) : b + 3]))
            yield pd.DataFrame(rows, columns=["source_file", "pdf_page", "ocr", "auth", "context"])

    return pairs.select("source_file", "pdf_page", "ocr", "auth").mapInPandas(f, "source_file string, pdf_page int, ocr string, auth string, context string")


def count_in_pages(pages: DataFrame, text: str) -> DataFrame:
    return pages.groupBy("book").agg(F.sum(disjoint_count(F.col("raw_text"), text)).alias("n"))


def aligned_pairs(pages: DataFrame, ocr: str, auth: str) -> DataFrame:
    """(ocr, auth): the characters in which two texts of one length differ, place by place; other pairs of texts give none."""
    chars = F.arrays_zip(F.split(ocr, "").alias("ocr"), F.split(auth, "").alias("auth"))
    rows = pages.where(F.length(ocr) == F.length(auth)).select(F.explode(chars).alias("c")).select("c.ocr", "c.auth")
    return rows.where("ocr <> auth")


def validate_sites(candidates: DataFrame, bigrams_: DataFrame) -> DataFrame:
    """Adds ok to candidates (id, find, replace): whether the corpus speaks for the replacement.

    The bigrams at both edges of what differs are looked up. The replacement's must be as frequent on each
    side, frequent enough on one, and clearly more frequent together.
    """
    differing = F.expr("if(length(find) > 0 AND length(find) = length(replace), filter(sequence(1, length(find)), i -> substring(find, i, 1) <> substring(replace, i, 1)), cast(array() AS array<int>))")
    rows = candidates.withColumn("__d", differing).withColumn("__a", F.array_min("__d")).withColumn("__b", F.array_max("__d"))
    left, right = "if(__a > 1, substring({c}, __a - 1, 2), null)", "if(__b < length(find), substring({c}, __b, 2), null)"
    sides = F.array(*[F.expr(x.format(c=c)) for c in ("find", "replace") for x in (left, right)])
    edges = rows.select("id", F.posexplode(sides).alias("side", "bigram")).join(bigrams_, "bigram", "left")
    n = [F.coalesce(F.max(F.when(F.col("side") == i, F.col("n"))), F.lit(0)).alias(f"f{i}") for i in range(4)]
    counted = edges.groupBy("id").agg(*n)
    ok = F.expr("size(__d) > 0 AND f2 >= f0 AND f3 >= f1 AND greatest(f2, f3) >= 3 AND f2 + f3 >= 3 * (f0 + f1 + 1)")
    return rows.join(counted, "id", "left").select("id", "find", "replace", F.coalesce(ok, F.lit(False)).alias("ok"))


def number_pages(detected: DataFrame, least: int = 20, share: float = 0.6) -> DataFrame:
    """number of each page (source_file, pdf_page, detected): by the file's constant offset, else page by page.

    An offset that enough detections agree on numbers all pages from 1. Else detected numbers stay, and
    others take the offset of the trusted ones (those of three detections or more) on both sides, if these
    agree, or of the one side that has any.
    """
    rows = detected.withColumn("__o", F.col("pdf_page") - F.col("detected"))
    sizes = rows.where("__o IS NOT NULL").groupBy("source_file", "__o").agg(F.count("*").alias("__n"))
    best = sizes.groupBy("source_file").agg(F.max_by("__o", F.struct("__n", -F.col("__o"))).alias("__best"), F.max("__n").alias("__most"), F.sum("__n").alias("__all"))
    best = best.select("source_file", "__best", (F.col("__most") >= F.greatest(F.lit(least), share * F.col("__all"))).alias("__constant"))
    rows = rows.join(sizes, ["source_file", "__o"], "left").join(best, "source_file", "left").withColumn("__t", F.when(F.col("__n") >= 3, F.col("__o")))
    order = Window.partitionBy("source_file").orderBy("pdf_page")
    rows = rows.withColumn("__a", F.last("__t", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__b", following_known("__t", "source_file", "pdf_page"))
    near = F.when(F.col("__a").isNull() | F.col("__b").isNull() | (F.col("__a") == F.col("__b")), F.coalesce("__a", "__b"))
    number = F.when(F.coalesce("__constant", F.lit(False)), F.col("pdf_page") - F.col("__best")).otherwise(F.coalesce("detected", F.col("pdf_page") - near))
    return rows.select("source_file", "pdf_page", F.when(number >= 1, number).cast("long").alias("number"))


def coverage(saved: DataFrame, live: DataFrame) -> DataFrame:
    """kind and key: stale keys are saved but not live, missing ones live but not saved, others both."""
    both = saved.select("key").distinct().withColumn("s", F.lit(1)).join(live.select("key").distinct().withColumn("l", F.lit(1)), "key", "full")
    return both.select(F.when(F.col("l").isNull(), "stale").when(F.col("s").isNull(), "missing").otherwise("both").alias("kind"), "key")


def backfill_printed(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages with missing printed numbers taken from another table of the same pages."""
    other = known.select("source_file", "pdf_page", F.col("printed_page").alias("__known"))
    rows = pages.join(other, ["source_file", "pdf_page"], "left")
    return rows.withColumn("printed_page", F.coalesce("printed_page", "__known")).drop("__known")


def projected(text: Column, member: str) -> Column:
    """text without all but the characters of a class, and places: where each of them stood."""
    chars = F.split(text, "")
    held = F.filter(F.transform(chars, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"].rlike(f"^{member}$"))
    return F.struct(F.array_join(F.transform(held, lambda x: x["c"]), "").alias("text"), F.transform(held, lambda x: x["i"]).alias("places"))
