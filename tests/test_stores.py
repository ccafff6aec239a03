"""Updates, ordered hashes and versions that a pointer makes current."""

import random

import pytest
from pyspark.sql import functions as F

from folia.operators import accounts
from folia.plans import stores
from folia.sources import sinks

PAGES = "book string, volume int, source_file string, pdf_page int, raw_text string, printed_page string"


def test_updates_see_the_row_as_it_was(spark):
    rows = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (3, None, 4)], "id int, state string, n int")
    got = accounts.update_where(rows, F.col("state") == "a", {"state": F.lit("x"), "n": F.length("state") + F.col("n")})
    assert {tuple(r) for r in got.collect()} == {(1, "x", 3), (2, "b", 3), (3, None, 4)}
    changes = spark.createDataFrame([(1, "p", None, 1), (1, "q", None, 2), (2, None, 9, 1), (7, "z", 9, 1), (None, "z", 9, 1)], "id int, state string, n int, at int")
    got = accounts.update_from(rows, changes, ["id"], [F.desc("at")], ["state", "n"])
    assert {tuple(r) for r in got.collect()} == {(1, "q", 2), (2, "b", 9), (3, None, 4)}
    got = accounts.update_from(rows, changes, ["id"], [F.desc("at")], ["state", "n"], F.col("new.n") > F.col("old.n"))
    assert {tuple(r) for r in got.collect()} == {(1, "a", 2), (2, "b", 9), (3, None, 4)}
    assert accounts.update_from(rows.limit(0), changes, ["id"], [F.desc("at")], ["n"]).count() == 0


def test_hashes_are_those_of_the_whole_books(spark):
    r = random.Random(5)
    text = "".join(r.choice("abc国家 \n") for _ in range(3000))
    cut = lambda k: (lambda at: [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)])(sorted(r.sample(range(len(text)), k)))
    table = lambda parts, book="a": [(book, 1 + i // 20, f"v{1 + i // 20:03}", i, t, None) for i, t in enumerate(parts)]
    want = str(int.from_bytes(text.encode(), "big") % sinks.PRIME)
    for k in (1, 7, 90):
        pages = spark.createDataFrame([*table(cut(k)), ("a", 9, "w", 1, None, None), ("b", 1, "b", 1, None, "1")], PAGES).repartition(5)
        assert {tuple(x) for x in sinks.ordered_hashes(pages).collect()} == {("a", k + 2, len(text.encode()), want), ("b", 1, 0, "0")}
    assert sinks.ordered_hashes(spark.createDataFrame([], PAGES)).count() == 0
    one = [("a", 1, "a", 1, "xy", None), ("b", 1, "b", 1, "x", None), ("c", 1, "c", 1, "x", None), ("e", 1, "e", 1, "x", "1")]
    two = [("a", 1, "a", 1, "x", None), ("a", 1, "a", 2, "y", None), ("b", 1, "b", 1, "z", None), ("d", 1, "d", 1, "x", None), ("e", 1, "e", 1, "x", "2")]
    got = sinks.verification(spark.createDataFrame(one, PAGES), spark.createDataFrame(two, PAGES))
    assert {tuple(x) for x in got.collect()} == {("a", "same", 1, 2, 2), ("b", "changed", 1, 1, 1), ("c", "removed", 1, 0, 1), ("d", "added", 0, 1, 1), ("e", "same", 1, 1, 1)}


def test_hashes_of_languages(spark):
    folder, books = "/root/testdata/sf0.001", {}
    for d in spark.read.parquet(f"{folder}/documents.parquet").collect():
        books.setdefault(d.lang, []).append((d.source is not None, d.source or "", d.doc_id, d.text or ""))
    want = {(b, len(x), str(int.from_bytes("".join(t for *_, t in sorted(x)).encode(), "big") % sinks.PRIME)) for b, x in books.items()}
    assert {(x.book, x.pages, x.hash) for x in stores.QUERIES["k_ordered_hashes"](spark, folder).collect()} == want


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert sinks.current_version(spark, folder, "t") is None
    sinks.commit_version(spark.range(3), folder, "t")
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.commit_version(broken, folder, "t")
    held = sinks.current_version(spark, folder, "t")
    sinks.commit_version(spark.range(7), folder, "t")
    assert (held.count(), sinks.current_version(spark, folder, "t").count(), sinks.current_version(spark, folder, "u")) == (3, 7, None)
