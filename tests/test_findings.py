"""Findings of a review: volumes longer than those of the small tables, ties, sums without pairs."""

import difflib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folia.operators import associative, corpus, feeds, prep, search
from folia.operators import contents as content_operators
from folia.plans import contents as content_plans
from folia.plans import sources as source_plans
from folia.session import stored
from folia.sources import articles

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long_volume(spark, tmp_path_factory):
    """Documents of a volume with marks enough to be taken for its contents, and of one that is too short for any."""
    folder = tmp_path_factory.mktemp("long")
    rows = [(i, f"text {i} of it", "en", "src1", 9) for i in range(130)] + [(i, f"short {i}", "de", "src2", 9) for i in range(200, 204)]
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["h_contents_parsed"])
def test_contents_of_a_long_volume_equal_their_sql(spark, long_volume, name):
    got = content_plans.QUERIES[name](spark, long_volume)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{long_volume}/documents.parquet/*.parquet'")
    found = con.execute(content_plans.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    wanted = sorted(found.fetchall())
    assert len(wanted) > 30
    assert sorted(tuple(r) for r in got.select(*names).collect()) == wanted


def test_undelivered_counts_equal_the_pairs(spark):
    rng = random.Random(5)
    maybe = lambda x: None if rng.random() < 0.05 else x
    articles = spark.createDataFrame([(maybe(rng.randrange(25)), maybe(rng.choice("ab")), maybe(rng.randrange(6))) for _ in range(60)], "article_id long, topic string, first_seen int")
    users = spark.createDataFrame([(maybe(rng.randrange(30)), maybe(rng.choice("abc")), maybe(rng.randrange(7))) for _ in range(50)], "subscription_id long, topic string, confirmed int")
    log = [(a, u, rng.choice(["sent", "skipped", "failed"])) for a in range(25) for u in range(30) if u < 4 or rng.random() < 0.4] * 2 + [(None, 3, "sent"), (3, None, "sent")]
    log = spark.createDataFrame(log, "article_id long, subscription_id long, status string")
    wanted = feeds.undelivered(articles, users, log).groupBy("subscription_id").agg(F.count("*").alias("articles"), F.min("article_id").alias("first"))
    got = feeds.undelivered_counts(articles, users, log)
    assert got.columns == wanted.columns
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert rows(got) == rows(wanted) and got.count() > 10


def test_following_values_take_one_pass(spark):
    from folia.functions.windows import following_known

    rng = random.Random(7)
    rows = [("v", i, rng.choice([None, None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, n int, x int").select("n", following_known("x", "g", "n").alias("behind"), following_known("x", "g", "n", own=True).alias("at"))
    for r in df.collect():
        assert r["behind"] == next((x for _, n, x in rows if n > r["n"] and x is not None), None)
        assert r["at"] == next((x for _, n, x in rows if n >= r["n"] and x is not None), None)
    # a frame up to a group's end would be computed anew for every row
    known = spark.createDataFrame(rows, "source_file string, sort_order int, known int")
    pages = known.select("source_file", F.col("sort_order").alias("pdf_page"), F.col("known").alias("detected"), F.col("known").cast("string").alias("printed_page"), F.lit("x").alias("raw_text"))
    for df in (prep.interpolated(known), prep.fill_printed_pages(pages), prep.number_pages(pages)):
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()


def test_entries_of_one_place_go_by_page(spark):
    rows = [("v", i % 7, (i * 37) % 91) for i in range(91)]
    wanted, highest = [], None
    for row in sorted(rows):
        if highest is None or row[2] >= highest:
            wanted.append(row)
        highest = row[2] if highest is None else max(highest, row[2])
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = prep.monotone_entries(spark.createDataFrame(rows, "source_file string, sort_order int, pdf_page int"))
        assert sorted(tuple(r) for r in got.collect()) == wanted


def test_pairs_within_the_bound_are_all_there(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdeé目") for _ in range(n))
    near = lambda t: "".join(c if rng.random() < 0.8 else rng.choice("abz") for c in t)
    titles = [("v", i, text(rng.choice([0, 1, 3, 8, 30, 63, 64, 65, 70, 300]))) for i in range(80)]
    marks = [("v", i, near(rng.choice(titles)[2])) for i in range(60)] + [("w", 1, "ab"), ("v", 99, None)]
    got = content_operators._candidates(spark.createDataFrame(titles, "source_file string, title_no long, norm string"), spark.createDataFrame(marks, "source_file string, mark_no long, norm string"), 0.55)
    assert "Exchange hashpartitioning(source_file#" in got._jdf.queryExecution().toString() and "char" not in got._jdf.queryExecution().toString()
    like = {(t, m): difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for _, t, a in titles for f, m, b in marks if f == "v" and a and b}
    wanted = {k: v for k, v in like.items() if v >= 0.55}
    assert {(r["title_no"], r["mark_no"]): r["likeness"] for r in got.collect()} == wanted and len(wanted) > 40


def test_texts_travel_in_small_batches_once_pages_are_stored(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    spark.range(3).write.parquet(f"{tmp_path}/rows")
    stored(spark.read.parquet(f"{tmp_path}/rows"), "small batches").count()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_seeds_of_a_text_and_of_a_quote_agree(spark):
    text = "目录 a\U0001f600bcdefghijklmnop" * 3
    hashes = search.seed_hashes(text)
    assert len(hashes) == len(text) - 11 and not len(search.seed_hashes("short"))
    quotes = spark.createDataFrame([(text[i : i + 20],) for i in range(8)] + [("short",), (None,)], "q string")
    assert [r.k for r in quotes.select(search._seed_key("q").alias("k")).collect()] == [*hashes[:8].tolist(), None, None]


def test_no_title_takes_the_mark_of_a_likelier_one(spark, tmp_path):
    assert content_operators.likest_pairs([(1, 7, 0.6), (2, 7, 0.9), (2, 8, 0.6), (3, 8, 0.6)]) == [(2, 7), (3, 8)]
    # in this volume the name of page 28, which has no mark, is 0.56 like the mark of page 163
    rows = [(i, "x", "en", "s2884", 1) for i in range(170)]
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = content_plans.QUERIES["j_title_pairs"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(content_plans.ORACLE_SQL["j_title_pairs"])
    assert sorted(map(tuple, got.select(*[c[0] for c in found.description]).collect())) == sorted(found.fetchall())


def test_sources_give_all_their_articles(spark, tmp_path):
    links = [i % 47 for i in range(90)]
    html = " ".join(f"<a href='/d/{i}'>Article {i}</a>" for i in links)
    spark.createDataFrame([(1, "http://w.example.org/x", html), (5, "http://w.example.org/y", "none")], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = source_plans.QUERIES["s_source_articles"](spark, str(tmp_path)).where("source = 1").orderBy("n").collect()
    assert [(r["n"], r["title"], r["url"]) for r in found] == [(i, f"Article {i}", f"http://w.example.org/d/{i}") for i in range(47)]

    web = lambda parser: ("web_html", json.dumps({"parser": parser}))
    forms = {
        "rss": ("rss", None, "<rss><channel>" + "".join(f"<item><title>T {i} &amp;amp; more</title><link>/r/{i}</link><description>Says {i}</description></item>" for i in range(60)) + "</channel></rss>"),
        "journal": (*web("ncpssd_journal"), " ".join(f"openDetail('/Literature/articleinfo?id=QK{i}2021003012') title='T {i} &amp; more'" for i in [*range(60), 3])),
        "openalex": ("openalex", None, json.dumps({"results": [{"id": f"w/{i}", "title": f"T {i} & more", "type": "article"} for i in range(60)]})),
        "crossref": ("crossref", None, json.dumps({"message": {"items": [{"title": [f"T {i} & more"], "type": "journal-article", "URL": f"http://d/{i}"} for i in range(60)]}})),
    }
    sources = spark.createDataFrame([(k, t, f"http://h.example.org/{k}", "1", "N", None, c) for k, (t, c, _) in forms.items()], "source string, source_type string, source_url string, issn string, name string, language string, config string")
    bodies = spark.createDataFrame([(f"{k}:1" if k in ("openalex", "crossref") else f"http://h.example.org/{k}", b) for k, (_, _, b) in forms.items()], "url string, body string")
    for most, many in ((None, 60), (40, 40)):
        rows = articles.articles(sources, articles.outcomes(sources, bodies, most=most)).orderBy("source", "n").collect()
        assert [(r["source"], r["title"]) for r in rows] == [(k, f"T {i} & more") for k in sorted(forms) for i in range(many)]
        assert {r["abstract"] for r in rows if r["source"] == "rss"} == {f"Says {i}" for i in range(many)}


def test_windows_behind_many_occurrences_are_found(spark):
    many = ["alpha" + "." * 300] * 60
    words = [f"key{c}" for c in "abcdefghijkl"]
    texts = {"en/a": [*many, "alpha gamma", *many, "x" * 300, "gamma soup alpha", "y" * 300, "gamma"], "en/b": ["".join(words), *many[:2]]}
    rows = [("en", v, f, i + 1, None, t.replace(".", "z")) for v, (f, parts) in enumerate(texts.items()) for i, t in enumerate(parts)]
    pages = corpus.normalized(spark.createDataFrame(rows, "book string, volume int, source_file string, pdf_page int, printed_page string, raw_text string"))
    whole = {f: "".join(t.replace(".", "z").replace(" ", "") for t in parts) for f, parts in texts.items()}
    at = whole["en/a"].index("gammasoupalpha")
    got = [tuple(r) for r in associative.keyword_cooccurrence(pages, ["alpha", "gamma", "soup"]).select("source_file", "distinct_keywords", "start", "end").collect()]
    assert got == [("en/a", 3, at, at + 14)]
    # all keywords count, not the first eight of them
    got = [tuple(r) for r in associative.keyword_cooccurrence(pages, words).select("source_file", "distinct_keywords", "start", "end", "score").collect()]
    assert got == [("en/b", 12, 0, 48, 88)]
    contents = spark.createDataFrame([("en/a", "Part", 1, 1, "body", 1)], "source_file string, title string, pdf_page int, level int, kind string, sort_order int")
    got = [tuple(r) for r in associative.chapter_focused(pages, contents, ["Part"], ["alpha", "gamma", "soup"]).select("start", "end", "score").collect()]
    assert got == [(at, at + 14, 99)]


def test_frames_of_windows_hold_any_number_of_terms(spark):
    # of the places before one at 200 those from 1 on are in its frame, whatever their terms
    for terms in (2, 3000):
        rows = [("in", 1, 0), ("in", 200, terms - 1), ("out", 0, terms - 1), ("out", 200, 0)]
        found = spark.createDataFrame(rows, "source_file string, start long, term int").withColumn("length", F.lit(4))
        got = associative._densest(found, ["source_file"], 1, terms).select("source_file", "distinct_keywords", "start", "end").collect()
        assert sorted(map(tuple, got)) == [("in", 2, 1, 204), ("out", 1, 200, 204)]


def test_all_evidence_of_all_pages_is_merged(spark):
    # 320 pages begin a chapter of their own, all but the first hundred of them with both keywords; 41 hold a fragment, 8 a quote
    texts = {i: f"page {i} " + "x" * 300 + ("alpha words and soup" if i > 100 else "") for i in range(1, 321)}
    texts |= {i: f"page {i} " + "z" * 300 + ("a fragment" if i <= 361 else "quoted by us" if i <= 369 else "") for i in range(321, 400)}
    pages = corpus.normalized(spark.createDataFrame([("en", 1, "en/a", i, str(i), t) for i, t in texts.items()], "book string, volume int, source_file string, pdf_page int, printed_page string, raw_text string"))
    titles = [("en/a", f"Letter {i}", i, 1, "body", i) for i in range(1, 321)] + [("en/a", "Other", 321, 1, "body", 321)]
    contents = spark.createDataFrame(titles, "source_file string, title string, pdf_page int, level int, kind string, sort_order int")
    rows = associative.locate(pages, contents, ["quoted by us"], ["alpha", "soup"], ["a fragment"], ["Letter"], most=None).collect()
    got = {r.first_page: (r.score, r.evidence) for r in rows}
    assert len(rows) == len(got) == 320 + 41 + 8
    assert {got[i] for i in range(1, 101)} == {(92, 1)} and {got[i][0] for i in range(101, 321)} == {100}
    assert [p for p, r in got.items() if r == (100, 2)] == [320] and {got[i] for i in range(321, 362)} == {(97, 1)}
    assert {got[i] for i in range(362, 370)} == {(100, 9)}
