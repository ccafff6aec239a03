"""The library from SQL: text functions, and a table function that locates a query in pages."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from folia.functions.matching import edit_le
from folia.functions.text import LEAST_QUERY, STRIPPED, nfkc, normalize_query

_STRIP = re.compile(f"[{STRIPPED}]+")


@F.pandas_udf(StringType())
def norm_text(texts: pd.Series) -> pd.Series:
    """NFKC without white space and punctuation; null stays null."""
    return texts.map(lambda t: t if t is None else _STRIP.sub("", unicodedata.normalize("NFKC", t)))


@F.pandas_udf(ArrayType(IntegerType()))
def find_all(texts: pd.Series, queries: pd.Series, overlap: pd.Series) -> pd.Series:
    """Zero-based starts of all occurrences, overlapping ones too if ``overlap``; null where an input is, none of an empty query."""

    def starts(text: str | None, query: str | None, step: bool | None) -> list[int] | None:
        if text is None or query is None or step is None:
            return None
        out, at = [], text.find(query) if query else -1
        while at >= 0:
            out.append(at)
            at = text.find(query, at + (1 if step else len(query)))
        return out

    return pd.Series([starts(*row) for row in zip(texts, queries, overlap, strict=True)], dtype=object)


@F.pandas_udf(StructType().add("distinct_terms", IntegerType()).add("start", LongType()).add("end", LongType()))
def best_window(starts: pd.Series, lengths: pd.Series, terms: pd.Series, width: pd.Series) -> pd.DataFrame:
    """The window of ``width`` characters with the most distinct terms, then the tightest, then the latest.

    starts, lengths and terms (numbers) are arrays of the same length, in any order; null without occurrences.
    """
    out = []
    for start, length, term, wide in zip(starts, lengths, terms, width, strict=True):
        places = [] if start is None else sorted(zip(start, term, length, strict=True))
        best, low, inside = None, 0, {}
        for at, name, size in places:
            inside[name] = inside.get(name, 0) + 1
            while places[low][0] <= at - wide:
                gone = places[low][1]
                inside[gone] -= 1
                low += 1
                if not inside[gone]:
                    del inside[gone]
            found = (len(inside), places[low][0] - at - size, places[low][0], at + size)
            best = found if best is None else max(best, found)
        out.append((best[0], best[2], best[3]) if best else (None, None, None))
    return pd.DataFrame(out, columns=["distinct_terms", "start", "end"]).astype({"distinct_terms": "Int32", "start": "Int64", "end": "Int64"})


class Locate:
    """locate(TABLE(pages), query): source_file, start, first_page and last_page of all matches, overlapping ones too.

    pages have source_file, pdf_page and norm. Each file's pages come in order; of those before only as many
    characters are kept as a match may need, with the pages that they stand on.
    """

    @staticmethod
    def analyze(pages: AnalyzeArgument, query: AnalyzeArgument) -> AnalyzeResult:
        held = pages.dataType
        if not pages.isTable or not isinstance(held, StructType) or not {"source_file", "pdf_page", "norm"} <= set(held.names):
            raise ValueError("locate() takes a table with source_file, pdf_page and norm, and a query")
        schema = StructType().add("source_file", held["source_file"].dataType).add("start", LongType()).add("first_page", held["pdf_page"].dataType).add("last_page", held["pdf_page"].dataType)
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("source_file")], orderBy=[OrderingColumn("pdf_page")])

    def __init__(self) -> None:
        self.tail, self.before, self.ends = "", 0, []

    def eval(self, row, query: str) -> Iterator[tuple]:  # noqa: ANN001
        q, text = normalize_query(query or ""), row["norm"] or ""
        if len(q) < LEAST_QUERY or not text:
            return
        seen, at = self.tail + text, max(0, len(self.tail) - len(q) + 1)
        start = self.before - len(self.tail)
        self.ends.append((self.before + len(text), row["pdf_page"]))
        while (at := seen.find(q, at)) >= 0:
            first = next(page for end, page in self.ends if end > start + at)
            yield row["source_file"], start + at, first, row["pdf_page"]
            at += 1
        self.before += len(text)
        self.tail = seen[-(len(q) - 1) :]
        self.ends = [x for x in self.ends if x[0] > self.before - len(self.tail)]


def register_functions(spark: SparkSession) -> None:
    """nfkc, norm_text, find_all, best_window, edit_le and the table function locate, for use in this session's SQL."""
    for name, function in (("nfkc", nfkc), ("norm_text", norm_text), ("find_all", find_all), ("best_window", best_window), ("edit_le", edit_le)):
        spark.udf.register(name, function)
    spark.udtf.register("locate", F.udtf(Locate))
