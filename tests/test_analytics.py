import datetime as dt

from pyspark.sql import functions as F

from folia.operators import analytics, feeds, lookup, prep
from folia.sources import readers, sinks
from folia.streaming.limiter import replay_limiter, stream_limiter

T0 = dt.datetime(2024, 1, 1, 12)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_limiter_does_not_record_rejections(spark, tmp_path):
    times = [0, 1, 2, 3, 59, 61, 62, 63]
    rows = spark.createDataFrame([(1, at(s)) for s in times] + [(2, at(0))], "key long, ts timestamp")
    want = [True, True, True, False, False, True, True, True]
    got = [r.accepted for r in replay_limiter(rows, 3, 60).where("key = 1").orderBy("ts").collect()]
    assert got == want
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = stream_limiter(stream, 3, 60).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.accepted for r in spark.table("limited").where("key = 1").orderBy("ts").collect()] == want


def test_presence_stream_equals_batch(spark, tmp_path):
    from folia.streaming.presence import presence_stream

    rows = spark.createDataFrame([(i % 5, at(37 * i), "view", i, 1.0) for i in range(200)], "actor long, ts timestamp, feature string, page int, amount double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = presence_stream(stream).writeStream.format("memory").queryName("present").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {r.bucket: r.actors for r in analytics.presence(rows).collect()}
    assert {r.bucket: r.actors for r in spark.table("present").collect()} == want


def test_page_runs_and_locks(spark):
    rows = spark.createDataFrame([(1, at(i), "view", p, 1.0) for i, p in enumerate([5, 1, 2, 3, 3, 9, 8])], "actor long, ts timestamp, feature string, page int, amount double")
    assert [r.page_run for r in analytics.page_runs(rows).collect()] == [3]
    assert analytics.login_locks(rows, 3, 15).count() == 5
    assert [r.accepted for r in analytics.quota_decisions(rows, 0.0).collect()] == [False] * 7


def test_gap_fill(spark):
    labels = ["1", None, "3", None, None, "5", None]
    texts = ["a", "b", "c", "", "d", "e", "f"]
    rows = spark.createDataFrame([("f", i + 1, p, x) for i, (p, x) in enumerate(zip(labels, texts, strict=True))], "source_file string, pdf_page int, printed_page string, raw_text string")
    got = [r.filled for r in prep.fill_printed_pages(rows).orderBy("pdf_page").collect()]
    assert got == ["1", "2", "3", None, "4", "5", None]


def test_lis_and_monotone(spark):
    rows = spark.createDataFrame([("f", i, p) for i, p in enumerate([1, 9, 2, 3, 3, 1, 4])], "source_file string, sort_order int, pdf_page int")
    assert [r.pdf_page for r in prep.longest_non_decreasing(rows).where("kept").orderBy("sort_order").collect()] == [1, 2, 3, 3, 4]
    assert [r.pdf_page for r in prep.monotone_entries(rows).orderBy("sort_order").collect()] == [1, 9]


def test_bigrams_of_han_runs(spark):
    rows = spark.createDataFrame([("中国中国 abc 国",)], "raw_text string")
    assert {r.bigram: r.n for r in prep.bigrams(rows).collect()} == {"中国": 2, "国中": 1}


def test_feeds(spark):
    row = spark.createDataFrame([("x",)], "x string")
    got = row.select(
        feeds.find_date(F.lit("seen 2021/3/4")).alias("a"), feeds.find_date(F.lit("2021-05")).alias("b"), feeds.find_date(F.lit("in 1999")).alias("c"), feeds.find_date(F.lit("none")).alias("d"),
        feeds.inverted_text(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2)))).alias("e"),
        feeds.unescape(F.lit("a &amp; b")).alias("f"), feeds.token_estimate(F.lit("  ")).alias("g"), feeds.token_estimate(F.lit("abc")).alias("h"),
    ).first()
    assert tuple(got) == ("2021-03-04", "2021-05-01", "1999-01-01", None, "a b a", "a & b", 0, 2)


def test_upsert_keeps_ignored_and_restores_archived(spark):
    schema = "dedupe_key string, title string, status string, seen int"
    current = spark.createDataFrame([("a", "A", "archived", 1), ("i", "I", "ignored", 1), ("r", "R", "ready", 1)], schema)
    incoming = spark.createDataFrame([("a", "A2", "pending", 2), ("i", "", "pending", 2), ("n", "N", "pending", 2)], schema)
    got = {r.dedupe_key: (r.title, r.status) for r in feeds.upsert(current, incoming).collect()}
    assert got == {"a": ("A2", "restored"), "i": ("I", "ignored"), "r": ("R", "ready"), "n": ("N", "pending")}


def test_lookup_order_and_slugs(spark):
    rows = spark.createDataFrame([("f", "Theory", 1, 1, 1), ("f", "The", 2, 1, 2), ("f", "On the way", 3, 1, 3), ("f", "the!", 4, 1, 4)], "source_file string, title string, pdf_page int, level int, sort_order int")
    assert [r.title for r in lookup.suggest(rows, "the").collect()] == ["The", "the!", "Theory", "On the way"]
    assert [r.slug for r in lookup.slugs(rows).orderBy("sort_order").collect()] == ["theory", "the", "on-the-way", "the-2"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"pdf_page": 1, "text": "a"}\nbroken\n{"pdf_page": 2}\n')
    assert [r.pdf_page for r in readers.read_sidecar(spark, str(tmp_path / "s.jsonl")).collect()] == [1]
    (tmp_path / "feed.xml").write_text("<rss><item><title><![CDATA[A & B]]></title><link>u</link></item><item><title>C</title></item></rss>")
    assert [(r.title, r.link) for r in readers.read_rss(spark, str(tmp_path / "feed.xml")).orderBy("n").collect()] == [("A & B", "u"), ("C", "")]
    names = spark.createDataFrame([("第 12 卷.pdf",), ("Volume 7.pdf",), ("03 text.pdf",), ("x.pdf",)], "n string")
    assert [r[0] for r in names.select(readers.volume_from_name(F.col("n"))).collect()] == [12, 7, 3, None]
    pages = spark.createDataFrame([("en", 1, "en/a", 1, "t", "1"), ("de", 1, "de/a", 1, "u", "1")], "book string, volume int, source_file string, pdf_page int, raw_text string, printed_page string")
    path = str(tmp_path / "pages")
    sinks.write_pages(pages, path)
    sinks.replace_books(pages.where("book = 'en'").withColumn("raw_text", F.lit("changed")), path)
    after = spark.read.parquet(path).select(pages.columns)
    assert {(r.source_file, r.change) for r in sinks.changes(pages, after).collect()} == {("en/a", "text")}
    assert {r.book: r.rows for r in sinks.checksums(after).collect()} == {"en": 1, "de": 1}
