"""Importance resampling against a plain count of every feature."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from folia.llm import importance

TEXTS = [None, "", " \n", "One", "one TWO", "a1 b2-c3 é_日本 x", "x" * 70_000, "Straße ÉCOLE Ünicode É"]


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_force(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([d[1] for d in docs], target))
    here, there = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (here + 10000) / ((s[b] + 1) * (there + 10000)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: 5 * len(fit) // 100])}
    return sorted(repr((*r[:4], rank.get(id(r)))) for r in rows)


def tables(spark, n=400):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 19, 20, 25, 200])))) for i in range(n)]
    docs += [(n + i, t) for i, t in enumerate(TEXTS)] + [(None, docs[4][1]), (None, None), (5, docs[5][1]), (5, docs[9][1])]
    docs += [(2000 + i, docs[3][1]) for i in range(40)] + [(3000, " ".join(rng.choice(words) for _ in range(9000)))]
    target = [" ".join(rng.choice(words[:40]) for _ in range(50)) for _ in range(20)] + [None, ""]
    clash = "doc_id long, text string, rank string, n_words string, doc_ids int"
    return docs, target, spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], clash).repartition(5), spark.createDataFrame([(t, 7) for t in target], "text string, item int")


@pytest.mark.parametrize("block", [1 << 20, 4000, 300])
def test_resampling_equals_brute_force(spark, monkeypatch, block):
    # at 4000 and 300 bytes long texts are counted in pieces
    monkeypatch.setattr(importance, "BLOCK", block)
    docs, target, df, wanted = tables(spark)
    got = importance.op11_importance(df, wanted)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_force(docs, target)


def test_pieces_count_like_the_whole(monkeypatch):
    rng = random.Random(5)
    text = " ".join("é" * rng.randrange(1, 5) + rng.choice("abc") for _ in range(3000)).encode()
    whole = importance._rows_of([text])
    for block in (1, 7, 500, 1 << 20):
        monkeypatch.setattr(importance, "BLOCK", block)
        pieces = importance._row_of(text)
        assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))


def test_ranks_go_on_over_ranges(spark):
    df = spark.range(1000).selectExpr("id % 50 as score", "id as doc_id").repartition(7)
    got = importance.numbered(df, df.score.desc(), df.doc_id.asc(), name="test-ranks").orderBy("rank").collect()
    assert [(r["score"], r["doc_id"]) for r in got] == sorted(((i % 50, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert [r["rank"] for r in got] == list(range(1, 1001))


def test_empty_tables(spark):
    docs, target, df, wanted = tables(spark, 60)
    assert importance.op11_importance(df.limit(0), wanted).count() == 0
    got = importance.op11_importance(df, wanted.limit(0)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_force(docs, [])


def test_blocks_are_written_a_few_at_a_time(spark):
    docs = spark.range(40).repartition(1).selectExpr("id AS doc_id", "repeat('some words of a text ', 60000) AS text")
    matrix = importance.count_matrix(docs, "doc_id", "blocks-a-few")
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in matrix.inputFiles()]
    sizes = [f.metadata.row_group(i).num_rows for f in files for i in range(f.metadata.num_row_groups)]
    # a task reads a row group's rows at once, so their number bounds its memory whatever the input
    assert sum(sizes) == 40 and max(sizes) <= importance.GROUP
