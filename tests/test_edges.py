"""Blank pages, books without configuration, white space of all kinds, stores whose files change."""

import random

import pytest
from pyspark.sql import functions as F

from folia.functions import fields
from folia.functions.text import trimmed
from folia.operators import corpus, feeds, planner, search
from folia.session import stored

PAGES = "book string, volume int, source_file string, pdf_page int, printed_page string, raw_text string"


def volumes(seed):
    rng = random.Random(seed)
    return [(b, 1, f"{b}/1", p, str(p), rng.choice([None, "", " 　", "，", "a", "ab", "ba b", "aabb", "b a"])) for b in ("en", "it", "xx") for p in range(1, 40)]


@pytest.mark.parametrize("query", ["ab", "aab", "bb", "abab", "bab"])
def test_matches_cross_blank_pages(spark, query):
    rows = volumes(len(query))
    pages = corpus.normalized(spark.createDataFrame(rows, PAGES)).cache()
    texts, ends = {}, {}
    for b, _, _, p, _, t in rows:
        own = "".join(c for c in t or "" if c in "ab")
        texts[b] = texts.get(b, "") + own
        ends.setdefault(b, []).append((p, len(texts[b]), bool(own)))
    counts = {r.book: r.hits for r in search.exact_counts(pages, query).collect()}
    spans = sorted((r.book, r.start, r.first_page, r.last_page) for r in search.match_spans(pages, query).collect())
    wanted = []
    for b, text in texts.items():
        page = lambda at, b=b: next(p for p, end, some in ends[b] if some and end > at)
        wanted += [(b, i, page(i), page(i + len(query) - 1)) for i in range(len(text)) if text.startswith(query, i)]
    assert spans == sorted(wanted)
    assert counts == {b: n for b in texts if (n := sum(w[0] == b for w in wanted))}
    none = spark.createDataFrame([], "source_file string, title string, pdf_page int, level int, kind string, sort_order int")
    total = {r.book: r.hits for r in search.chapter_counts(pages, none, query).where("volume IS NULL AND book IS NOT NULL").collect()}
    assert total == {b: text.count(query) for b, text in texts.items() if query in text}


def test_books_without_configuration_come_last(spark):
    pages = corpus.normalized(spark.createDataFrame([(b, 1, f"{b}/1", 1, "1", "alpha beta") for b in ("it", "en", "aa")], PAGES))
    books, hits = corpus.book_dimension(spark), search.distinct_hits(search.exact_hits(pages, "alpha"))
    assert {(r.book, r.sort_order, r.hits) for r in search.book_facets(hits, books).collect()} == {("en", 10, 1), ("aa", 9999, 1), ("it", 9999, 1)}
    none = spark.createDataFrame([], "source_file string, title string, pdf_page int, level int, kind string, sort_order int")
    groups = search.group_hits(hits, pages, corpus.with_sections(pages.select("source_file", "pdf_page", "printed_page"), none), books)
    assert [r.book for r in groups.collect()] == ["en", "aa", "it"]
    assert {r.citation for r in search.citations(hits, pages, books).collect()} >= {"it, vol. 1, Beijing: People's Press, xxxx, p. 1."}
    assert [r.book for r in planner.flat_search(pages, books, "alpha").collect()] == ["en", "aa", "it"]


def test_white_space_of_all_kinds(spark):
    df = spark.createDataFrame([("　张三　李四\x1d王五\xa0",)], "t string")
    one = lambda c: df.select(c.alias("x")).first()["x"]
    assert one(fields.split_authors(df.t)) == ["张三", "李四", "王五"]
    assert one(fields.collapsed(df.t)) == "张三 李四 王五"
    assert one(fields.given(F.lit("　\x1c "))) is None
    assert one(trimmed(F.lit("\x1f　 a b "))) == "a b"
    assert one(feeds.strip_tags(F.lit("<p>　甲</p> 乙"))) == "甲 乙"
    assert one(fields.highlight_terms(F.lit("国家　理论"))) == ["国家 理论", "国家理论", "国家", "理论"]
    assert one(fields.excerpt(F.lit("甲　乙 丙丁"), 4)) == "甲 乙…"
    assert one(fields.paragraphs(F.lit("一\n　\n二"))) == ["一", "二"]


def test_stores_follow_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    read = lambda: stored(spark.read.parquet(path).withColumn("x", F.lit(1)), "edges of t").count()
    assert (read(), read()) == (3, 3)
    spark.range(5).write.mode("overwrite").parquet(path)
    assert read() == 5
