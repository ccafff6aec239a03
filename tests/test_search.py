import pytest
from pyspark.sql import functions as F

from folia.operators import associative, corpus, search

PAGES = [
    ("en", 1, "en/a", 1, None, "alpha beta aba"),
    ("en", 1, "en/a", 2, "2", "ba gamma alpha"),
    ("en", 1, "en/a", 3, "3", ""),
    ("en", 1, "en/a", 4, "4", "beta alphabet soup aba aba"),
    ("de", 2, "de/b", 1, "pre-i", "alpha alpha"),
    ("de", 2, "de/b", 2, "1", "nothing here"),
]
TOC = [("en/a", "One", 1, 1, "body", 1), ("en/a", "Two", 2, 2, "body", 2), ("en/a", "Letter", 4, 1, "letter", 3), ("de/b", "Late", 2, 1, "body", 1)]


@pytest.fixture(scope="module")
def pages(spark):
    rows = spark.createDataFrame(PAGES, "book string, volume int, source_file string, pdf_page int, printed_page string, raw_text string")
    return corpus.normalized(rows).cache()


@pytest.fixture(scope="module")
def contents(spark):
    return spark.createDataFrame(TOC, "source_file string, title string, pdf_page int, level int, kind string, sort_order int")


def volumes():
    out = {}
    for book, volume, file, _, _, raw in PAGES:
        out.setdefault((book, volume, file), []).append(raw.replace(" ", ""))
    return {k: "".join(v) for k, v in out.items()}


@pytest.mark.parametrize("query", ["alpha", "aba", "ababa", "alphabeta", "a", "zz"])
def test_counts_cross_pages(pages, query):
    got = {(r.book, r.volume): r.hits for r in search.exact_counts(pages, query).collect()}
    want = {}
    for (book, volume, _), text in volumes().items():
        n = sum(text.startswith(query, i) for i in range(len(text))) if len(query) > 1 else 0
        if n:
            want[book, volume] = n
    assert got == want


def test_spans_limit_and_distinct(pages):
    spans = sorted((r.source_file, r.start, r.first_page, r.last_page) for r in search.match_spans(pages, "ababa").collect())
    assert spans == [("en/a", 9, 1, 2)]
    hits = search.exact_hits(pages, "alpha", 2)
    assert sorted((r.book, r.ord, r.truncated) for r in hits.collect()) == [("de", 1, True), ("de", 2, True), ("en", 1, True), ("en", 2, True)]
    assert search.distinct_hits(hits).where("book = 'de'").count() == 1


def test_sections_and_chapters(pages, contents):
    got = {(r.source_file, r.pdf_page): r.section for r in corpus.with_sections(pages, contents).collect()}
    assert got["en/a", 1] == "One" and got["en/a", 3] == "Two" and got["en/a", 4] == "Letter"
    assert got["de/b", 1] == "Late"
    chapters = {(r.source_file, r.pdf_page): r.chapter.title for r in corpus.with_chapters(pages, contents).collect()}
    assert chapters["en/a", 3] == "Two" and chapters["en/a", 4] == "Letter" and chapters["de/b", 1] == "Late"


def test_no_contents_gives_null_sections(pages, contents):
    assert corpus.with_sections(pages, contents.limit(0)).where("section IS NOT NULL").count() == 0
    assert {r.title for r in corpus.segments(pages, contents.limit(0)).collect()} == {corpus.NO_CHAPTER}


@pytest.mark.parametrize("query", ["alpha", "aba", "ab"])
def test_chapter_counts_are_disjoint_inside_segments(pages, contents, query):
    got = {(r.book, r.volume, r.chapter_pdf_page): r.hits for r in search.chapter_counts(pages, contents, query).collect()}
    total = 0
    for r in corpus.segments(pages, contents).collect():
        text = volumes()[r.book, r.volume, r.source_file][r.norm_start : r.norm_end]
        n = text.count(query)
        total += n
        assert got.get((r.book, r.volume, r.chapter_pdf_page), 0) == n
    assert got.get((None, None, None), 0) == total


def test_citation_and_context(spark, pages):
    hits = search.distinct_hits(search.exact_hits(pages, "alpha"))
    texts = {(r.source_file, r.first_page): r.citation for r in search.citations(hits, pages, corpus.book_dimension(spark)).collect()}
    assert texts["en/a", 2].endswith("xxxx, p. 2.")
    assert texts["en/a", 1].endswith("p. 1 (file page).")
    got = {r.pdf_page: r.c for r in pages.where("book = 'en'").select("pdf_page", search.context(F.col("raw_text"), "aba", 1).alias("c")).collect()}
    assert got[4] == "beta alphabet soup aba [[H]]aba[[/H]]"
    assert got[2] == "ba gamma alpha" and got[3] == ""


def test_fuzzy_finds_one_error(spark):
    rows = spark.createDataFrame([("en", 1, "en/a", 1, "1", "xx the quick brovn fox yy"), ("en", 2, "en/b", 1, "1", "unrelated text of some length")], "book string, volume int, source_file string, pdf_page int, printed_page string, raw_text string")
    got = [(r.volume, r.errors) for r in search.fuzzy_pages(corpus.normalized(rows), "the quick brown").collect()]
    assert got == [(1, 1)]


def test_quotes_are_located(spark, pages):
    quotes = spark.createDataFrame([(1, "alphabet soup aba"), (2, "not in any of the pages"), (3, "gamma alpha beta alphabet")], "item_id int, quote string")
    got = sorted((r.item_id, r.pdf_page) for r in search.locate_quotes(pages, quotes).collect())
    assert got == [(1, 4), (3, 2)]


def test_cooccurrence_against_two_pointers(pages):
    got = {r.source_file: (r.distinct_keywords, r.start, r.end) for r in associative.keyword_cooccurrence(pages, ["alpha", "gamma", "soup"]).collect()}
    for (_, _, file), text in volumes().items():
        occ = sorted((i, k, len(w)) for k, w in enumerate(["alpha", "gamma", "soup"]) for i in range(len(text)) if text.startswith(w, i))
        best = None
        for r, (at, _, n) in enumerate(occ):
            inside = [o for o in occ[: r + 1] if o[0] >= at - 199]
            cand = (len({o[1] for o in inside}), inside[0][0] - (at + n), inside[0][0], at + n)
            if cand[0] >= 2 and (best is None or cand > best):
                best = cand
        assert got.get(file) == (best and (best[0], best[2], best[3]))


def test_associative_merges_evidence(pages, contents):
    rows = associative.locate(pages, contents, ["beta alphabet soup"], ["alpha", "soup"], ["alphabet"], ["Letter"]).collect()
    assert rows[0].first_page == 4 and rows[0].score == 100
