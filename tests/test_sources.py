"""Sources by type: candidates, forms, the first that serves, outcomes, abstracts looked up."""

import json
import re

from folia.sources import articles

SOURCE = "source long, source_type string, source_url string, issn string, name string, language string, config string"
RESPONSE = "url string, body string"
BASE = "https://journals.example.org/details"


def rss(*items, end="</channel></rss>"):
    return '<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title>' + "".join(f"<item>{x}</item>" for x in items) + end


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title><entry><title type="html">On &amp;amp; off</title><link rel="alternate" href="/a/1"/>
<summary>&lt;p&gt;Short&lt;/p&gt; text</summary><updated>2024-02-03T00:00:00Z</updated></entry><entry><title></title></entry></feed>"""
LIST = (
    '<nav><a href="/">首页</a><a name="x">No target here</a></nav><ul>'
    + "<li>2023年4月5日 <a class=t href='art/1?a=1&amp;b=2'>Value <b>and</b> Labour</a></li>"
    + "<li><a href='art/1?a=1&amp;b=2'>Value again, the same target</a></li>"
    + '<li><A HREF="https://other.example.org/art/2">再论&ldquo;资本&rdquo;的逻辑</A> '
    + "x" * 400 + "</li><li><a href='/help/me'>Where to find help</a></li></ul>"
)
RECORDS = "".join(
    f"<a onclick=\"openDetail('/Literature/articleinfo?id={i}&type=x')\" href='#' title='{t}'>..</a><span class='writer'>{w}</span><span class='pages'>({p})</span>" + "." * 700
    for i, t, w, p in [("QK2021003012", "论价值形式", "张三[1,2];李四[3]", "3-12"), ("QK2021003012", "论价值形式（重）", "", ""), ("AB12", "没有年份的文章", "王五", "9"), ("QK2022012001", "目录", "", "")]
)


def run(spark, sources, responses):
    sources = spark.createDataFrame(sources, SOURCE)
    found = articles.outcomes(sources, spark.createDataFrame(responses, RESPONSE), BASE).cache()
    rows = [r.asDict() for r in articles.articles(sources, found).orderBy("source", "n").collect()]
    states = {r["source"]: (r["outcome"], r["url"], r["errors"]) for r in found.collect()}
    found.unpersist()
    return states, rows


def test_candidates_are_listed_once_in_order(spark):
    config = lambda **v: json.dumps(v)
    rows = [
        (1, " RSS ", "http://b", None, "n", None, config(entry_url=" http://a ", fallback_urls=["http://b", "", "http://c", "http://a"])),
        (2, "web_html", None, None, "n", None, config(parser="ncpssd_journal", gch=" 77 ", entry_url="http://e")),
        (3, "web_html", f"{BASE}?gch=77", None, "n", None, config(parser="ncpssd_journal", gch="77")),
        (4, "openalex", "http://unused", " 1234-5678 ", "n", None, None), (5, "crossref", None, " ", "n", None, None),
        (6, "manual", "http://m", "1", "n", None, "{}"), (7, None, "http://m", None, None, None, "broken {"), (8, "rss", "http://z", None, None, None, "broken {"),
    ]
    found = {}
    for r in articles.candidates(spark.createDataFrame(rows, SOURCE), BASE).orderBy("source", "n").collect():
        found.setdefault(r["source"], []).append(r["url"])
    assert found == {1: ["http://a", "http://b", "http://c"], 2: [f"{BASE}?gch=77", "http://e"], 3: [f"{BASE}?gch=77"], 4: ["openalex:1234-5678"], 8: ["http://z"]}


def test_feeds(spark):
    items = "<title>A &amp;amp; B</title><link> /x/1 </link><description><![CDATA[<p>One</p> two]]></description><pubDate>Mon, 1 Jan 2024</pubDate>"
    sources = [(i, "rss", f"http://h.example.org/f{i}", None, "N", None, json.dumps({"fallback_urls": [f"http://h.example.org/g{i}"]})) for i in range(1, 6)]
    bodies = [
        ("http://h.example.org/f1", rss(items, "<title></title>", "<link>http://h/2</link>", "<media:title xmlns:media='m'>No</media:title><title>Two</title>")),
        # broken, so the next one counts; a feed that can be read and is empty serves
        ("http://h.example.org/f2", rss(items, end="</chan")), ("http://h.example.org/g2", ATOM),
        ("http://h.example.org/f3", rss()), ("http://h.example.org/g3", rss(items)),
        ("http://h.example.org/f4", None), ("http://h.example.org/g4", "not xml at all"),
        ("http://h.example.org/f5", rss(*[f"<title>T {i}</title>" for i in range(30)])),
    ]
    states, rows = run(spark, sources, bodies)
    h = "http://h.example.org"
    assert states == {1: ("served", f"{h}/f1", 0), 2: ("served", f"{h}/g2", 1), 3: ("served", f"{h}/f3", 0), 4: ("failed", None, 2), 5: ("served", f"{h}/f5", 0)}
    short = [(r["source"], r["title"], r["url"], r["abstract"], r["published_at"], r["language"], r["requires_review"]) for r in rows if r["source"] < 5]
    assert short == [
        (1, "A & B", f"{h}/x/1", "One two", "Mon, 1 Jan 2024", "zh", False), (1, "Two", f"{h}/f1", "", "", "zh", False),
        (2, "On & off", f"{h}/a/1", "Short text", "2024-02-03T00:00:00Z", "zh", False),
    ]
    assert [r["title"] for r in rows if r["source"] == 5] == [f"T {i}" for i in range(25)]


def test_web_pages(spark):
    web = lambda i, **v: (i, "web_html", f"http://w.example.org/d/{i}.html", None, "N", "zh", json.dumps(v))
    sources = [web(1, auto_publish=True), web(2, link_selector="/art/"), web(3, parser="ncpssd_journal", fallback_urls=["http://w.example.org/d/rec"]), web(4), web(5)]
    bodies = [("http://w.example.org/d/1.html", LIST), ("http://w.example.org/d/2.html", LIST), ("http://w.example.org/d/3.html", "<p>moved</p>"), ("http://w.example.org/d/rec", RECORDS), ("http://w.example.org/d/4.html", "")]
    states, rows = run(spark, sources, bodies)
    assert {k: (v[0], v[2]) for k, v in states.items()} == {1: ("served", 0), 2: ("served", 0), 3: ("served", 0), 4: ("empty", 0), 5: ("failed", 1)}
    got = [(r["source"], r["title"], r["url"], r["published_at"], r["requires_review"]) for r in rows]
    assert got == [
        (1, "Value and Labour", "http://w.example.org/d/art/1?a=1&b=2", "2023-04-05", False), (1, "再论“资本”的逻辑", "https://other.example.org/art/2", "2023-04-05", False),
        (1, "Where to find help", "http://w.example.org/help/me", "", False),
        (2, "再论“资本”的逻辑", "https://other.example.org/art/2", "2023-04-05", True),
        (3, "论价值形式", "http://w.example.org/Literature/articleinfo?id=QK2021003012&type=x", "2021-01-01", True),
        (3, "没有年份的文章", "http://w.example.org/Literature/articleinfo?id=AB12&type=x", "", True),
    ]
    records = [(r["authors"], r["issue"], r["pages"]) for r in rows if r["source"] == 3]
    assert records == [(["张三", "李四"], "3", "3-12"), (["王五"], "", "9")]


def test_dates_of_links_are_searched_as_far_as_told_before_and_after_them(spark):
    link = lambda n: f"<a href='/{n}'>Title {n}</a>"
    bodies = [
        # wide characters before a link once hid it
        "é😀" * 200 + "2021-02-03" + link(0) + "😀" * 400 + link(1), "2020-01-02" + "x" * 230 + link(0), "2020-01-02" + "x" * 231 + link(0), link(0) + "x" * 350 + "2019-05-06", link(0) + "x" * 351 + "2019-05-06",
        # over several links before
        "2018-07-08" + link(0) + link(1) + link(2), "2018-07-08" + "x" * 190 + link(0) + link(1) + link(2), "2018-07-08" + "<a></a>" * 32 + link(0), "2018-07-08" + "<a></a>" * 33 + link(0),
    ]
    sources = [(i, "web_html", f"http://w/{i}", None, "N", None, None) for i in range(len(bodies))]
    _, got = run(spark, sources, [(f"http://w/{i}", b) for i, b in enumerate(bodies)])
    want = {}
    for i, body in enumerate(bodies):
        for n, m in enumerate(re.finditer("<a href='[^']*'>[^<]*</a>", body)):
            near = body[max(0, m.start() - 240) : m.start()] + m[0] + body[m.end() : m.end() + 360]
            day = re.search(r"(20\d\d)-(\d\d)-(\d{1,2})", near)
            want[i, n] = (f"Title {n}", f"{day[1]}-{day[2]}-{day[3]:0>2}" if day else "")
    assert {(r["source"], r["n"]): (r["title"], r["published_at"]) for r in got} == want


def test_works_of_services_and_abstracts_looked_up(spark):
    work = {
        "id": "https://w/1", "doi": "https://doi.org/10.1/A", "title": " Value form ", "type": "article", "publication_date": "2024-01-02", "abstract_inverted_index": {"b": [1], "a": [0, 2]},
        "authorships": [{"author": {"display_name": "Ann B"}}, {"author": {"display_name": " "}}], "primary_location": {"landing_page_url": "https://l/1", "source": {"display_name": "J"}},
        "biblio": {"volume": "3", "issue": "4", "first_page": "5", "last_page": "9"},
    }
    bare = [{"id": f"https://w/b{i}", "doi": f"10.2/{i}", "title": f"Bare work {i}"} for i in range(18)]
    works = {"results": [work, {**work, "type": "dataset"}, {**work, "title": "Editorial Board"}, *bare]}
    item = {"title": ["On", "value"], "container-title": [], "type": "journal-article", "abstract": "<jats:p>Some  text</jats:p>", "DOI": "10.3/x", "URL": "https://d/x", "page": "1-2",
            "author": [{"family": "Li", "given": "W"}, {}], "published-print": {"date-parts": [[]]}, "published": {"date-parts": [[2023, 5]]}}
    sources = [(1, "openalex", None, "1", "N", None, None), (2, "crossref", None, "2", "N", None, None), (3, "openalex", None, "3", "N", None, None), (4, "crossref", None, None, "N", None, None)]
    bodies = [("openalex:1", json.dumps(works)), ("crossref:2", json.dumps({"message": {"items": [item, {**item, "type": "book"}]}})), ("openalex:3", "<html>busy</html>")]
    states, rows = run(spark, sources, bodies)
    assert {k: (v[0], v[2]) for k, v in states.items()} == {1: ("served", 0), 2: ("served", 0), 3: ("failed", 1), 4: ("none", 0)}
    first, other = rows[0], rows[-1]
    assert len(rows) == 20 and [first[c] for c in ("title", "url", "abstract", "doi", "authors", "volume", "issue", "pages", "journal", "language")] == [
        "Value form", "https://l/1", "a b a", "10.1/A", ["Ann B"], "3", "4", "5-9", "J", "en"]
    assert [other[c] for c in ("title", "url", "abstract", "authors", "published_at", "pages", "journal")] == ["On value", "https://d/x", "Some text", ["Li W"], "2023-05-01", "1-2", "N"]
    table = spark.createDataFrame([(r["source"], r["n"], r["doi"], r["abstract"]) for r in rows], "source long, n int, doi string, abstract string")
    details = spark.createDataFrame([(f" 10.2/{i}", f"<p>About {i}</p>") for i in range(18)], "doi string, abstract string")
    known = [r["abstract"] for r in articles.with_abstracts(table, details).where("source = 1").orderBy("n").collect()]
    assert known == ["a b a", *[f"About {i}" for i in range(15)], "", "", ""]


def test_no_sources_and_no_responses(spark):
    assert run(spark, [], []) == ({}, [])
