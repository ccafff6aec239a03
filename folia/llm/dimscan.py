"""Approximate nearest neighbours by an adaptive scan of dimensions within probed lists.

Vectors are dealt to lists by their nearest centroid. A query probes the lists whose centroids are nearest to it.
Within a list vectors and queries are rotated by a random matrix and compared a block of columns at a time: after
each block a test asks whether the distance over these columns, taken for a sample of the whole distance, is
already too long for the query's best so far, and candidates that fail it are given up. What is left is scored on
the original vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import free, key_runs, stage

#: Neighbours of each query.
NEAREST = 20
#: Vectors, about, on which centroids and probes are fitted, and lists, at most; lists otherwise are the root of the number.
SAMPLE, LISTS, TURNS = 16_384, 1024, 8
#: Share of trial queries' neighbours that must lie in the probed lists, and trial queries.
COVER, TRIALS = 0.985, 400
#: Columns of a block, and the test's width: it gives up where a distance over d of D columns exceeds the
#: bound by 1 + WIDTH / sqrt(d).
COLUMNS, WIDTH = 16, 2.4
#: Vectors, and queries, of a list that meet in one task at a time.
MEMBERS, QUERIES = 4096, 2048
#: Vectors scanned between two looks at the queries' best, and the share of live pairs below which pairs are compared one by one.
STEP, SPARSE = 512, 0.15
SEED = 12


@lru_cache(8)
def rotation(dimensions: int) -> np.ndarray:
    """A random rotation, the same in every process."""
    return np.linalg.qr(np.random.default_rng([SEED, dimensions]).standard_normal((dimensions, dimensions)))[0]


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over the longest length, with a further component that makes all equally long.

    Nearness between those and a query with a component of 0 goes by the inner product alone.
    """
    scaled = vectors / longest
    return np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1)))])


def _unit(queries: np.ndarray) -> np.ndarray:
    """Queries of length 1 with the further component."""
    return np.column_stack([queries / np.sqrt((queries * queries).sum(1))[:, None], np.zeros(len(queries))])


def _nearest(points: np.ndarray, centroids: np.ndarray, number: int) -> np.ndarray:
    """Numbers of the nearest centroids of each point, nearest first."""
    distance = (centroids * centroids).sum(1) - 2 * points @ centroids.T
    if number == 1:
        return distance.argmin(1)[:, None]
    return np.argsort(distance, axis=1, kind="stable")[:, :number]


def fit(sample: np.ndarray, vectors: int, longest: float, k: int = NEAREST) -> tuple[np.ndarray, int]:
    """Centroids, and the lists that a query probes, fitted on a sample of this many vectors."""
    points = _lifted(sample, longest)
    lists = int(min(LISTS, max(1, np.sqrt(vectors)), max(1, len(points) // 8)))
    rng = np.random.default_rng(SEED)
    centroids = points[rng.choice(len(points), lists, replace=False)]
    own = np.zeros(len(points), np.int64)
    for _ in range(TURNS):
        own = np.concatenate([_nearest(points[at : at + 4096], centroids, 1)[:, 0] for at in range(0, len(points), 4096)])
        sums, numbers = np.zeros_like(centroids), np.bincount(own, minlength=lists)
        np.add.at(sums, own, points)
        held = numbers > 0
        centroids[held] = sums[held] / numbers[held, None]
    own = np.concatenate([_nearest(points[at : at + 4096], centroids, 1)[:, 0] for at in range(0, len(points), 4096)])
    # how far down a query's lists its neighbours lie; in the sample neighbours are farther than in the whole
    trials = rng.choice(len(points), min(TRIALS, len(points)), replace=False)
    asked = _unit(sample[trials] / longest)
    scores = asked @ points.T
    scores[np.arange(len(trials)), trials] = -np.inf
    found = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(points) - 1)]
    places = np.argsort(_nearest(asked, centroids, lists), axis=1)
    depth = np.sort(np.take_along_axis(places, own[found], axis=1).ravel())
    probes = int(depth[min(len(depth) - 1, int(COVER * len(depth)))]) + 1 if len(depth) else 1
    return centroids, probes


def scan(members: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, score) of candidates for each query's k best inner products; none below its bound is needed.

    All of one query's members that reach the k-th best score seen are given back, ties included.
    """
    dimensions = members.shape[1]
    turn = rotation(dimensions)
    # in a scale in which squares neither overflow nor vanish
    unit = max(np.abs(members).max(), np.abs(queries).max())
    originals, members, queries = (members, queries), members / unit, queries / unit
    long_members, long_queries = (members * members).sum(1), (queries * queries).sum(1)
    # single precision decides only what is given up; its errors are allowed for
    turned, asked = ((x @ turn).astype(np.float32) for x in (members, queries))
    edges = [*range(0, dimensions, COLUMNS), dimensions]
    squares = {(a, b): ((turned[:, a:b] ** 2).sum(1), (asked[:, a:b] ** 2).sum(1)) for a, b in zip(edges, edges[1:], strict=False)}
    bound = bound.copy()
    best = np.repeat(bound[:, None], 1, axis=1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(members), STEP):
        to = min(len(members), at + STEP)
        scale = long_queries[:, None] + long_members[None, at:to]
        # an inner product reaches the bound where the squared distance is at most this
        known = np.isfinite(bound)
        limit = np.where(known[:, None], scale - 2 * (np.where(known, bound, 0) / unit / unit)[:, None], np.inf) + 1e-5 * scale
        partial, alive, pairs = np.zeros(scale.shape, np.float32), None, None
        for a, b in squares:
            wide = (1 + WIDTH / np.sqrt(b)) ** 2 * b / dimensions if b < dimensions else 1.0
            if pairs is None:
                ours, theirs = squares[a, b]
                partial += ours[at:to][None, :] + theirs[:, None] - 2 * asked[:, a:b] @ turned[at:to, a:b].T
                alive = partial <= wide * limit
                if b < dimensions and alive.mean() < SPARSE or b == dimensions:
                    pairs = alive.nonzero()
                    partial = partial[pairs]
            else:
                q, m = pairs
                partial = partial + ((asked[q, a:b] - turned[m + at, a:b]) ** 2).sum(1)
                live = partial <= wide * limit[q, m]
                pairs, partial = (q[live], m[live]), partial[live]
        q, m = pairs
        score = np.concatenate([(originals[1][q[i : i + 65536]] * originals[0][m[i : i + 65536] + at]).sum(1) for i in range(0, len(q), 65536)] or [np.zeros(0)])
        fine = score >= bound[q]
        q, m, score = q[fine], m[fine] + at, score[fine]
        out.append((q, m, score))
        best, bound = _raised(best, bound, q, score, k)
    q, m, score = (np.concatenate(x) for x in zip(*out, strict=True))
    fine = score >= bound[q]
    return q[fine], m[fine], score[fine]


def _raised(best: np.ndarray, bound: np.ndarray, q: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k best scores with these, and the bounds that they give."""
    if not len(q):
        return best, bound
    order = np.lexsort((-score, q))
    q, score = q[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    held = place < k
    fresh = np.full((len(best), min(k, int(place.max()) + 1)), -np.inf)
    fresh[q[held], place[held]] = score[held]
    best = -np.sort(-np.column_stack([best, fresh]), axis=1)[:, :k]
    # the first column stands for the bound given from outside; a full row's last one is a k-th best
    return best, np.maximum(bound, best[:, k - 1]) if best.shape[1] == k else bound


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


_FINE = "size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0)"


def _located(plans: dict[int, tuple[np.ndarray, int, float]], queries: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The list of each vector, or the lists that each query probes, by length; first: the nearest one."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths):
                centroids, probes, longest = plans[int(length)]
                rows = np.flatnonzero(lengths == length)
                # some rows at a time, as a query stands in each of its lists
                step = max(1, 65536 // probes) if queries else 4096
                for at in range(0, len(rows), step):
                    piece = batch.take(pa.array(rows[at : at + step]))
                    vectors = _matrix(piece.column("embedding"))
                    points = _unit(vectors / longest) if queries else _lifted(vectors, longest)
                    lists = _nearest(points, centroids, probes if queries else 1)
                    spread = np.repeat(np.arange(len(piece)), lists.shape[1])
                    first = np.tile(np.arange(lists.shape[1]) == 0, len(piece))
                    out = piece.take(pa.array(spread))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(lists.ravel().astype(np.int32)), pa.array(first)], [*out.schema.names, "list", "first"])

    return f


def _met(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates of each part of a list: its members come before its queries; ties go to the smaller least id."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, ["key"]):
            asks = group["asks"].combine_chunks().to_numpy(zero_copy_only=False)
            number = int((~asks).sum())
            if not number or number == len(asks):
                continue
            vectors, (ids, least, bounds) = _matrix(group["embedding"]), (group[c].to_numpy() for c in ("rep", "least", "bound"))
            q, m, score = scan(vectors[:number], vectors[number:], bounds[number:], k)
            order = np.lexsort((ids[m], least[m], -score, q))
            q, m, score = q[order], m[order], score[order]
            held = np.arange(len(q)) - np.searchsorted(q, q) < k
            yield pa.RecordBatch.from_arrays([pa.array(ids[number:][q[held]]), pa.array(ids[m[held]]), pa.array(least[m[held]]), pa.array(score[held])], ["query", "rep", "least", "score"])

    return f


def _candidates(index: DataFrame, probes: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """query, rep and score: the best of each probed part of a list.

    Lists are cut into parts of MEMBERS vectors and QUERIES queries by hash, and each part of the one meets
    each of the other, so that no list is held whole.
    """
    asked = probes.groupBy("length", "list").agg(F.count("*").alias("asked"))
    parts = sizes.join(F.broadcast(asked), ["length", "list"]).select("length", "list", F.expr(f"(members + {MEMBERS} - 1) div {MEMBERS}").alias("m_parts"), F.expr(f"(asked + {QUERIES} - 1) div {QUERIES}").alias("q_parts"))

    def dealt(df: DataFrame, own: str, other: str, asks: bool, bound: str) -> DataFrame:
        df = df.join(F.broadcast(parts), ["length", "list"])
        df = df.withColumn("own", F.expr(f"pmod(xxhash64(rep), {own})")).withColumn("other", F.explode(F.expr(f"sequence(0L, {other} - 1)")))
        a, b = ("other", "own") if asks else ("own", "other")
        return df.select(F.concat_ws(":", "length", "list", a, b).alias("key"), F.lit(asks).alias("asks"), "rep", "least", "embedding", F.expr(bound).alias("bound"))

    both = dealt(index, "m_parts", "q_parts", False, "0D").unionByName(dealt(probes, "q_parts", "m_parts", True, "bound"))
    met = both.repartition("key").sortWithinPartitions("key", "asks").mapInArrow(_met(k), "query long, rep long, least long, score double")
    return stage(met, "scan-candidates")


def search(vectors: DataFrame, asks: str, k: int = NEAREST) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of each row of vectors (vec_id, embedding) where ``asks``.

    Nearness is the inner product in double precision, of vectors of equal length; ties go to the smaller
    vec_id. Candidates are all rows but the query's own: a row that repeats a vec_id is one of its own, both as a
    query and as a candidate. Rows whose vec_id is null and vectors that are null, empty, zero or hold null or
    non-finite components take no part. Queries without candidates, and empty tables, give no row. Further columns
    are not read.

    Equal vectors are one in the index, with the k + 1 smallest of their rows, which is all that an answer can
    take. First each query scans its nearest list; the k-th best found there is the bound with which it
    scans its other lists.
    """
    rows = vectors.where(f"vec_id IS NOT NULL AND coalesce({_FINE}, false)").select(F.col("vec_id").cast("long"), "embedding").withColumn("row", F.monotonically_increasing_id())
    rows = stage(rows, "scan-rows")
    # of equal vectors: the rows that answers can take, found in tasks before anything is dealt out
    few = rows.withColumn("place", F.expr("row_number() over (partition by embedding order by vec_id, row)")).where(F.col("place") <= k + 1)
    few = few.groupBy("embedding").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("members"))
    asked = rows.where(asks).select("embedding").distinct().withColumn("asked", F.lit(True))
    reps = few.join(asked, "embedding", "left").select("embedding", "members", F.coalesce("asked", F.lit(False)).alias("asked"), F.size("embedding").alias("length"))
    reps = stage(reps.select("*", F.col("members")[0]["row"].alias("rep"), F.col("members")[0]["vec_id"].alias("least")), "scan-vectors")

    size = F.sqrt(F.expr("aggregate(embedding, 0D, (s, x) -> s + double(x) * double(x))"))
    plans: dict[int, tuple[np.ndarray, int, float]] = {}
    for r in reps.groupBy("length").agg(F.count("*").alias("n"), F.max(size).alias("longest")).collect():
        some = (F.col("length") == r["length"]) & F.expr(f"pmod(xxhash64(rep), {max(SAMPLE, r['n'])}) < {SAMPLE}")
        sample = reps.where(some).select("rep", "embedding").toArrow().sort_by("rep")
        centroids, probes = fit(_matrix(sample["embedding"]), r["n"], r["longest"], k + 1)
        plans[r["length"]] = centroids, probes, r["longest"]
    slim = reps.select("rep", "least", "length", "embedding", "asked")
    kind = f"array<{reps.schema['embedding'].dataType.elementType.simpleString()}>"
    located = f"rep long, least long, length int, embedding {kind}, list int, first boolean"
    index = stage(slim.drop("asked").mapInArrow(_located(plans, False), located), "scan-index")
    sizes = index.groupBy("length", "list").agg(F.count("*").alias("members"))
    queries = slim.where("asked").drop("asked").mapInArrow(_located(plans, True), located)
    near = _candidates(index, queries.where("first").withColumn("bound", F.lit(float("-inf"))), sizes, k + 1)
    bounds = near.withColumn("place", F.expr("row_number() over (partition by query order by score desc, least, rep)")).where(F.col("place") == k + 1)
    bounds = bounds.select(F.col("query").alias("rep"), F.col("score").alias("bound"))
    rest = queries.where("NOT first").join(bounds, "rep", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    far = _candidates(index, rest, sizes, k + 1)

    best = near.unionByName(far).withColumn("place", F.expr("row_number() over (partition by query order by score desc, least, rep)")).where(F.col("place") <= k + 1)
    # representatives as their rows, and of those the best k + 1, as one may be the query itself
    best = best.join(reps.select("rep", "members"), "rep").select("query", "score", F.explode("members").alias("m")).select("query", "score", "m.*")
    best = best.withColumn("place", F.expr("row_number() over (partition by query order by score desc, vec_id, row)")).where(F.col("place") <= k + 1)
    best = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "row", "score"))).alias("best"))
    answers = best.join(reps.select(F.col("rep").alias("query"), "embedding"), "query").select("embedding", "best")
    asking = rows.where(asks).select(F.col("vec_id").alias("query_id"), F.col("row").alias("self"), "embedding")
    found = asking.join(answers, "embedding").select("query_id", F.posexplode(F.expr(f"slice(filter(best, b -> b.row <> self), 1, {k})")).alias("at", "b"))
    found = stage(found.select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score"), "scan-found")
    free(rows, reps, index, near, far)
    return found


def op12_neighbours(vectors: DataFrame) -> DataFrame:
    return search(vectors, "vec_id % 20 = 0")
