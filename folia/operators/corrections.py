"""Corrections of texts by rules: for all pages, for a volume, for one page, and in a page's projection to some characters.

rules have rule_id, volume, pdf_page, find, replace and expected; projected (boolean) and conf (text) where a table
has them. A rule without page holds for its volume, one without volume for all.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The characters that projections keep, and the word that marks a rule as sure.
HAN, SURE = "一-鿿", "high"
#: Rules for more than a page that a task holds at a time; more are applied in rounds, in their order.
WIDE = 50_000


def _optional(rules: DataFrame, name: str, default: object) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in rules.columns else F.lit(default)


def checked_rules(rules: DataFrame) -> DataFrame:
    """rules with fine: something to find, a replacement, marked as sure if at all, and if projected a page and equal lengths."""
    projected = _optional(rules, "projected", False)
    fine = (F.coalesce(F.length("find"), F.lit(0)) > 0) & F.col("replace").isNotNull() & (_optional(rules, "conf", SURE) == SURE)
    fine &= F.col("pdf_page").isNull() | F.col("volume").isNotNull()
    fine &= ~projected | (F.col("pdf_page").isNotNull() & (F.length("find") == F.length("replace")))
    return rules.select("rule_id", "volume", "pdf_page", "find", "replace", "expected", projected.alias("projected"), F.coalesce(fine, F.lit(False)).alias("fine"))


class Wide:
    """Rules (volume or None, find, replace) that apply one after another, each to all its occurrences.

    An automaton finds which rules have something to do at all; after each one that did, the text is looked
    through again, as it may have made or unmade what later ones find.
    """

    def __init__(self, rules: list[tuple[int | None, str, str]]) -> None:
        self.rules, self.machine = rules, ahocorasick.Automaton()
        for i, (_, find, _) in enumerate(rules):
            self.machine.add_word(find, (*self.machine.get(find, ()), i))
        if rules:
            self.machine.make_automaton()

    def apply(self, text: str, volume: int | None) -> tuple[str, int]:
        at, applied = 0, 0
        while at < len(self.rules):
            due = min((i for _, held in self.machine.iter(text) for i in held if i >= at and self.rules[i][0] in (None, volume)), default=None)
            if due is None:
                break
            text, at, applied = text.replace(*self.rules[due][1:]), due + 1, applied + 1
        return text, applied


def projected_edits(text: str, rules: list[tuple[str, str, int | None]], member: str = HAN) -> tuple[str, int, int]:
    """(text, applied, refused): rules of equal lengths applied to the characters of a class alone, wherever others stand between.

    All rules look at the same projection; a rule whose occurrences, overlapping ones too, are not as many as
    expected is refused. Of edits at one place the last counts.
    """
    ranges = [(member[i], member[i + 2]) for i in range(0, len(member), 3)]
    places = [i for i, c in enumerate(text) if any(a <= c <= b for a, b in ranges)]
    seen, out, applied = "".join(text[i] for i in places), list(text), 0
    for find, replace, expected in rules:
        starts, at = [], seen.find(find)
        while at >= 0:
            starts.append(at)
            at = seen.find(find, at + 1)
        if not starts or (expected is not None and len(starts) != expected):
            continue
        applied += 1
        for start in starts:
            for k, (a, b) in enumerate(zip(find, replace, strict=True)):
                if a != b:
                    out[places[start + k]] = b
    return "".join(out), applied, len(rules) - applied


def page_edits(text: str, rules: list[tuple[str, str, int | None, bool]], member: str = HAN) -> tuple[str, int, int]:
    """(text, applied, refused) of a page's own rules in order: plain ones, each on what those before left, then projected ones."""
    applied = refused = 0
    for find, replace, expected, projected in rules:
        if projected:
            continue
        n = text.count(find)
        if n and (expected is None or n == expected):
            text, applied = text.replace(find, replace), applied + 1
        else:
            refused += 1
    text, more, less = projected_edits(text, [r[:3] for r in rules if r[3]], member)
    return text, applied + more, refused + less


def _widely(rules: list[tuple[int | None, str, str]]) -> Callable[..., Column]:
    @F.pandas_udf("text string, applied int")
    def widely(texts: pd.Series, volumes: pd.Series, before: pd.Series) -> pd.DataFrame:
        machine = Wide(rules)
        done = [(t, 0) if t is None else machine.apply(t, v) for t, v in zip(texts, volumes, strict=True)]
        return pd.DataFrame({"text": [d[0] for d in done], "applied": [d[1] + n for d, n in zip(done, before, strict=True)]})

    return widely


def apply_corrections(pages: DataFrame, rules: DataFrame, member: str = HAN) -> DataFrame:
    """Adds corrected, applied and ambiguous to pages (volume, pdf_page, raw_text).

    Rules for all pages come first, then those for the volume, then the page's own, each by rule_id. A page's own
    rule applies only if the page holds it as often as expected (null: any number), else it is ambiguous.
    Rules that checked_rules() refuses don't apply. Null texts stay null.
    """
    rules = checked_rules(rules).where("fine")
    wide = rules.where("pdf_page IS NULL").orderBy(F.col("volume").isNotNull(), "rule_id").select("volume", "find", "replace")
    out = pages.withColumn("__c", F.struct(F.col("raw_text").alias("text"), F.lit(0).alias("applied")))
    at = 0
    while held := wide.offset(at).limit(WIDE).collect():
        at += len(held)
        out = out.withColumn("__c", _widely([tuple(r) for r in held])(F.col("__c.text"), F.col("volume"), F.col("__c.applied")))

    # a page's own rules are met on volume and page
    own = rules.where("pdf_page IS NOT NULL").groupBy("volume", "pdf_page").agg(F.array_sort(F.collect_list(F.struct("rule_id", "find", "replace", "expected", "projected"))).alias("__r"))
    out = out.join(own, ["volume", "pdf_page"], "left")

    @F.pandas_udf("text string, applied int, ambiguous int")
    def narrowly(texts: pd.Series, finds: pd.Series, replaces: pd.Series, expected: pd.Series, projected: pd.Series) -> pd.DataFrame:
        done = []
        for text, *parts in zip(texts, finds, replaces, expected, projected, strict=True):
            if text is None or parts[0] is None:
                done.append((text, 0, 0))
            else:
                done.append(page_edits(text, [(f, r, None if e < 0 else int(e), bool(p)) for f, r, e, p in zip(*parts, strict=True)], member))
        return pd.DataFrame(done, columns=["text", "applied", "ambiguous"])

    part = lambda name: F.transform("__r", lambda r: r[name])
    number = F.transform("__r", lambda r: F.coalesce(r["expected"], F.lit(-1)))
    out = out.withColumn("__n", narrowly(F.col("__c.text"), part("find"), part("replace"), number, part("projected")))
    return out.select(*pages.columns, F.col("__n.text").alias("corrected"), (F.col("__c.applied") + F.col("__n.applied")).alias("applied"), F.col("__n.ambiguous").alias("ambiguous"))


def merged_rules(rules: DataFrame, accepted: DataFrame, pages: DataFrame, member: str = HAN) -> DataFrame:
    """state of each accepted rule (accepted_id, volume, pdf_page, find, replace), with expected where it is added.

    degenerate: nothing to find, no change, or another length. duplicate: the same volume, page and find are among
    projected rules or accepted before. unmatched: the page's projection doesn't hold it. added: as often as
    expected says, counted without overlap.
    """
    size = F.coalesce(F.length("find"), F.lit(0))
    degenerate = F.coalesce((size == 0) | (F.col("find") == F.col("replace")) | (size != F.length("replace")), F.lit(True))
    rows = accepted.select("accepted_id", "volume", "pdf_page", "find", "replace", degenerate.alias("degenerate"))
    texts = pages.select("volume", "pdf_page", F.regexp_replace(F.coalesce("raw_text", F.lit("")), f"[^{member}]", "").alias("seen"))
    rows = rows.join(texts, ["volume", "pdf_page"], "left").withColumn("seen", F.coalesce("seen", F.lit("")))
    times = F.when(~F.col("degenerate"), ((F.length("seen") - F.length(F.call_function("replace", F.col("seen"), F.col("find"), F.lit("")))) / size).cast("int"))
    old = checked_rules(rules).where("projected").select("volume", "pdf_page", "find", F.lit(True).alias("known")).distinct()
    rows = rows.withColumn("times", times).join(old, ["volume", "pdf_page", "find"], "left")
    # the first that matches is added, and later ones of its kind are its duplicates
    fits = ~F.col("degenerate") & F.col("known").isNull() & (F.col("times") > 0)
    first = F.min(F.when(fits, F.col("accepted_id"))).over(Window.partitionBy("volume", "pdf_page", "find"))
    rows = rows.withColumn("first", first)
    state = F.when(F.col("degenerate"), "degenerate").when(F.col("known") | (F.col("first") < F.col("accepted_id")), "duplicate").when(F.col("times") == 0, "unmatched").otherwise("added")
    return rows.select("accepted_id", "volume", "pdf_page", "find", "replace", state.alias("state"), F.when(state == "added", F.col("times")).alias("expected"))
