"""Nearest neighbours against brute force: rows, ties, scores and recall."""

import numpy as np
import pytest

from folia.llm import dimscan

SCHEMA = "vec_id long, embedding array<float>, label int, list int, rep string"


def table(spark, vectors, parts=5):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in vectors], SCHEMA).repartition(parts)


def clusters(number, dimensions, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((12, dimensions))
    x = np.concatenate([rng.standard_normal((number // 2, dimensions)), middle[rng.integers(0, 12, number - number // 2)] + 0.3 * rng.standard_normal((number - number // 2, dimensions))])
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x[rng.permutation(number)])]


def brute_force(vectors, every=20, k=20):
    """The k best rows of each query row, and all scores."""
    fine = [(i, v) for i, v in vectors if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for at, (i, v) in enumerate(fine):
        if i % every == 0:
            near = [(float(np.dot(np.float64(v), np.float64(w))), j) for b, (j, w) in enumerate(fine) if b != at and len(w) == len(v)]
            out.append((i, sorted(near, key=lambda x: (-x[0], x[1]))[:k]))
    return out


def answers(got):
    held = {}
    for r in got.collect():
        held.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [x[1:] for x in sorted(x)] for q, x in held.items()}


def test_odd_rows_ties_and_copies(spark, monkeypatch):
    # all neighbours of the trials, here all rows, lie in probed lists
    monkeypatch.setattr(dimscan, "COVER", 1.0)
    rng = np.random.default_rng(4)
    # small whole numbers: many equal scores
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(150)]
    vectors += [(200 + i, vectors[20][1]) for i in range(50)]
    vectors += [(300, None), (320, []), (340, [0.0] * 4), (360, [1.0, None, 0.0, 0.0]), (380, [float("nan"), 1.0, 1.0, 1.0]), (400, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    vectors += [(420, [1.0, 2.0]), (421, [3.0, -1.0]), (440, [1.0, 1.0, 1.0])]
    got = dimscan.op12_neighbours(table(spark, vectors))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    found, wanted = answers(got), brute_force(vectors)
    assert set(found) == {i for i, near in wanted if near}
    for i, near in wanted:
        assert [(j, s) for s, j in near] == found.get(i, [])
        assert i not in [j for j, _ in found.get(i, [])]


@pytest.mark.parametrize("parts", [(4096, 2048, 512), (60, 30, 16)])
def test_recall_and_exact_scores(spark, monkeypatch, parts):
    # at the small sizes lists are cut into parts, which meet each other
    for name, value in zip(("MEMBERS", "QUERIES", "STEP"), parts, strict=True):
        monkeypatch.setattr(dimscan, name, value)
    vectors = clusters(3000, 48)
    of = dict(vectors)
    found, wanted = answers(dimscan.op12_neighbours(table(spark, vectors))), brute_force(vectors)
    assert set(found) == {i for i, _ in wanted}
    hits = 0
    for i, near in wanted:
        assert len(found[i]) == 20 and len({j for j, _ in found[i]}) == 20
        assert [s for _, s in found[i]] == sorted((s for _, s in found[i]), reverse=True)
        for j, s in found[i]:
            assert s == pytest.approx(np.dot(np.float64(of[i]), np.float64(of[j])), rel=1e-12)
        hits += len({j for j, _ in found[i]} & {j for _, j in near})
    assert hits >= 0.9 * 20 * len(wanted)


def test_scan_gives_up_early_and_loses_little():
    x = np.array([v for _, v in clusters(4000, 96, 3)])
    members, queries = x[:3900], x[3900:]
    for scale in (1.0, 1e120, 1e-120):
        q, m, score = dimscan.scan(members * scale, queries * scale, np.full(len(queries), -np.inf), 20)
        lost = 0
        for i in range(len(queries)):
            best = np.sort(queries[i] @ members.T)[::-1][:20]
            held = np.sort(score[q == i])[::-1][:20] / scale / scale
            lost += 20 - np.isclose(held, best[: len(held)]).sum()
        assert lost <= 0.02 * 20 * len(queries)
    # bounds from outside are kept
    bound = np.sort(queries @ members.T, axis=1)[:, -5] - 1e-9
    q, m, score = dimscan.scan(members, queries, bound, 20)
    assert (score >= bound[q]).all() and len(q) <= 5 * len(queries) + 1 and len(q) >= 4.8 * len(queries)


def test_lengths_may_differ_and_tables_be_empty(spark, monkeypatch):
    monkeypatch.setattr(dimscan, "COVER", 1.0)
    df = table(spark, clusters(50, 8))
    assert dimscan.op12_neighbours(df.limit(0)).count() == 0
    assert dimscan.op12_neighbours(df.where("vec_id = 40")).count() == 0
    assert dimscan.op12_neighbours(df.where("vec_id % 20 <> 0")).count() == 0
    long = [(i, [float(i), 2.0 * i % 7, 1.0, float(i % 3)][: 2 + i % 3]) for i in range(1, 100)]
    found = answers(dimscan.search(table(spark, long), "true", 3))
    assert all([(j, s) for s, j in near] == found[i] for i, near in brute_force(long, 1, 3))
