"""Text functions on columns: normalisation, positions, shingles, allowed errors."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that normalisation removes.
STRIPPED = r"\s\x1c-\x1f\u2000-\u206f\u2e00-\u2e7f\u3000-\u303f\uff00-\uffef!-/:-@\[-`{-~"
STRIP_PATTERN = f"(?U)[{STRIPPED}]+"
#: Shorter normalised queries find nothing, and shorter ones than the second are never matched with errors.
LEAST_QUERY, LEAST_FUZZY, MOST_ERRORS = 2, 10, 2


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


#: White space as Unicode has it, and the separators U+001C to U+001F; for patterns that begin with (?U).
WHITE = r"[\s\x1c-\x1f]"


def trimmed(text: Column | str) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, f"(?U)^{WHITE}+|{WHITE}+$", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP_PATTERN, "")


def normalize(text: Column) -> Column:
    """NFKC, then without white space and punctuation; case stays. Meant for ingestion: the result is a stored column."""
    return strip(nfkc(text))


def normalize_query(query: str) -> str:
    """normalize() of a driver-side query string."""
    return re.sub(f"[{STRIPPED}]+", "", unicodedata.normalize("NFKC", query))


def quoted(text: str) -> str:
    """A regular expression that matches text as it is."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def overlapping_count(text: Column, query: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?={quoted(query)})"))


def disjoint_count(text: Column, query: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(query), F.lit("")))) / len(query)).cast("int")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda s, x: s + x)


def positions(text: Column, query: str) -> Column:
    """Zero-based starts of all occurrences, overlapping ones too.

    A split before every occurrence leaves parts as long as the distances between starts; sums over the
    parts before are kept by block, so that long texts stay near linear. A match at the very start
    leaves no empty part before it.
    """
    step = 64
    block = lambda i: F.floor(i / step).cast("int")

    def starts(lengths: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), block(F.size(lengths) - 1)), lambda b: _total(F.slice(lengths, b * step + 1, F.lit(step))))
        before = let(whole, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda b: _total(F.slice(w, F.lit(1), b))))
        return let(before, lambda sums: F.transform(lengths, lambda _, i: F.get(sums, block(i)) + _total(F.slice(lengths, block(i) * step + 1, i % step))))

    found = let(F.transform(F.split(text, f"(?={quoted(query)})", -1), lambda p: F.length(p)), starts)
    found = let(found, lambda s: F.when(F.startswith(text, F.lit(query)), s).otherwise(F.slice(s, F.lit(2), F.size(s))))
    return F.when(F.contains(text, F.lit(query)), found).otherwise(F.array().cast("array<int>"))


def _grams(text: Column, n: int) -> Column:
    every = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))


def shingles(text: Column, lengths: tuple[int, ...] = (5, 6, 8), cap: int = 8) -> Column:
    """Distinct character n-grams, length by length, the first ``cap`` of them."""
    return F.slice(F.array_distinct(F.concat(*[_grams(text, n) for n in lengths])), 1, cap)


def allowed_errors(length: int) -> int:
    return 0 if length < LEAST_FUZZY else min(MOST_ERRORS, length // 10)
