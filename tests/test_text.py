import random

from pyspark.sql import functions as F

from folia.functions import text as t


def test_normalize_folds_then_strips(spark):
    rows = [("Ａ　b, c!",), ("a\x1c\x85b c",), (None,), ("",), ("«a·b»",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(t.normalize(F.col("x"))).collect()]
    assert got == ["Abc", "abc", None, "", "«a·b»"]
    assert t.normalize_query("Ａ　b, c!") == "Abc"


def test_positions_and_counts_match_a_scan(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé") for _ in range(rng.choice([0, 1, 5, 40, 700]))) for _ in range(60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for q in ("a", "ab", "aba", "aa", "é", ".*"):
        got = {r.i: (r.p, r.o, r.d) for r in df.select("i", t.positions(F.col("x"), q).alias("p"), t.overlapping_count(F.col("x"), q).alias("o"), t.disjoint_count(F.col("x"), q).alias("d")).collect()}
        for i, x in enumerate(texts):
            want = [k for k in range(len(x) - len(q) + 1) if x.startswith(q, k)]
            assert got[i] == (want, len(want), x.count(q)), (q, x)


def test_shingles_and_allowed_errors(spark):
    got = spark.createDataFrame([("abcdefgh",), ("abc",)], "x string").select(t.shingles(F.col("x"))).collect()
    assert got[0][0] == ["abcde", "bcdef", "cdefg", "defgh", "abcdef", "bcdefg", "cdefgh", "abcdefgh"]
    assert got[1][0] == []
    assert [t.allowed_errors(n) for n in (9, 10, 19, 20, 99)] == [0, 1, 1, 2, 2]
