"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a product code: a rotated vector is cut into two halves, each half has a random code,
and every pair of code words is a direction. A vector is list-decoded to all directions whose inner
product with it exceeds a threshold; near vectors share directions, are joined on them and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import connected_components, stage

COSINE = 0.98
#: Directions that a vector exceeds on average, and unrelated vectors with which it shares one.
FILTERS, UNRELATED = 100, 0.2
#: Share of pairs at the least cosine that must meet, trial pairs that measure it, and rotations at most.
RECALL, TRIALS, ROTATIONS = 0.995, 2000, 16
#: Vectors of a block; the pairs of a shared direction are compared block by block.
BLOCK = 1024
#: Vectors shorter than this are padded with zeros before they are rotated.
LEAST_DIMENSIONS = 16
SEED = 7


def _padded(dimensions: int) -> int:
    return max(LEAST_DIMENSIONS, dimensions + dimensions % 2)


def threshold(share: float, dimensions: int) -> float:
    """The inner product that this share of all unit vectors exceeds, by the surface of spherical caps."""
    # in logarithms: the sine's power underflows where dimensions are many
    angle = np.linspace(0, np.pi / 2, 200_001)[1:]
    density = np.exp((dimensions - 2) * np.log(np.sin(angle)))
    caps = np.cumsum(density) / (2 * density.sum())
    return float(np.cos(np.interp(share, caps, angle)))


@lru_cache(64)
def plan(vectors: int, dimensions: int, cosine: float = COSINE) -> tuple[float, int, int]:
    """(threshold of scores, words of each half's code, rotations) for so many vectors of so many dimensions.

    Rotations are added until trial pairs at ``cosine`` share a direction often enough.
    """
    share = min(1e-3, UNRELATED / max(vectors, 1))
    least, words = threshold(share, _padded(dimensions)), int(np.ceil(np.sqrt(FILTERS / share)))
    if vectors < 2 or dimensions < 2:
        return least, words, 1
    rng = np.random.default_rng(SEED + 1)
    first, aside = rng.standard_normal((2, TRIALS, dimensions))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    aside -= (aside * first).sum(1, keepdims=True) * first
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    apart = np.arange(TRIALS)
    second = cosine * first + np.sqrt(max(0.0, 1 - cosine * cosine)) * aside
    for rotation in range(ROTATIONS):
        apart = np.array([i for at in range(0, len(apart), 256) for i in _apart(first, second, apart[at : at + 256], least, words, rotation)], np.int64)
        if len(apart) <= (1 - RECALL) * TRIALS:
            break
    return least, words, rotation + 1


def _apart(first: np.ndarray, second: np.ndarray, rows: np.ndarray, least: float, words: int, rotation: int) -> list[int]:
    """Those rows whose two vectors share no direction of a rotation."""
    pairs = zip(rows, _exceeded(first[rows], least, words, rotation), _exceeded(second[rows], least, words, rotation), strict=True)
    return [i for i, a, b in pairs if not len(np.intersect1d(a, b, assume_unique=True))]


@lru_cache(32)
def _code(dimensions: int, words: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """A numbered rotation and the code words of both halves, the same in every process."""
    rng = np.random.default_rng([SEED, number])
    padded = _padded(dimensions)
    rotation = np.linalg.qr(rng.standard_normal((padded, padded)))[0][:dimensions]
    halves = rng.standard_normal((2, words, padded // 2))
    return rotation, halves / np.linalg.norm(halves, axis=2, keepdims=True) / np.sqrt(2)


def _exceeded(unit: np.ndarray, least: float, words: int, number: int) -> list[np.ndarray]:
    """For each row the numbers of a rotation's directions that it exceeds; its best one where there is none."""
    rotation, halves = _code(unit.shape[1], words, number)
    turned = unit @ rotation
    half = turned.shape[1] // 2
    left, right = turned[:, :half] @ halves[0].T, turned[:, half:] @ halves[1].T
    out = []
    for a, b in zip(left, right, strict=True):
        # only words that exceed the threshold with the other half's best
        rows, columns = np.flatnonzero(a >= least - b.max()), np.flatnonzero(b >= least - a.max())
        order = columns[np.argsort(-b[columns], kind="stable")]
        held = np.searchsorted(-b[order], a[rows] - least, side="right")
        found = [i * words + order[:n] for i, n in zip(rows, held, strict=True) if n] or [np.array([a.argmax() * words + b.argmax()])]
        out.append(np.sort(np.concatenate(found)) + number * words * words)
    return out


def decode(unit: np.ndarray, least: float, words: int, rotations: int) -> list[np.ndarray]:
    """For each row the numbers of all directions that it exceeds, of all rotations in order."""
    turns = [_exceeded(unit, least, words, number) for number in range(rotations)]
    return [np.concatenate(found) for found in zip(*turns, strict=True)]


def _units(column: pa.Array) -> np.ndarray:
    vectors = np.array(column.to_pylist(), np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of equal key, of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            if end == start:
                continue
            if held and keys[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = keys[start]
    if held:
        yield pa.Table.from_batches(held)


def compare(group: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each row of a group: the weight of the rows it links with, and the least id it reaches.

    A group holds vectors of one direction, of one block or of two; pairs of two blocks are those across.
    Pairs that share a smaller direction are counted there.
    """
    unit = _units(group["embedding"].combine_chunks())
    ids, weight = group["rep"].to_numpy(), group["weight"].to_numpy()
    own = group["filter"].to_numpy()[0]
    # the product in double precision, of whole rows
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    first, second, block = (group[c].to_numpy() for c in ("first", "second", "block"))
    if first[0] != second[0]:
        near &= block[:, None] != block[None, :]
    roots = ids.copy()
    while near.any():
        least = np.minimum(roots, np.where(near, roots[None, :], np.iinfo(np.int64).max).min(1))
        if (least == roots).all():
            break
        roots = least
    rows = np.flatnonzero(near.any(1))
    links = np.zeros(len(ids), np.int64)
    if len(rows):
        filters = [np.array(f, np.int64) for f in group["filters"].take(rows).to_pylist()]
        smaller = np.concatenate([f[f < own] for f in filters])
        names = np.unique(smaller)
        holds = np.zeros((len(rows), len(names)), np.float32)
        for i, f in enumerate(filters):
            holds[i, np.searchsorted(names, f[f < own])] = 1
        counted = near[np.ix_(rows, rows)] & (holds @ holds.T == 0)
        links[rows] = counted @ weight[rows]
    return links, roots


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of vectors (vec_id, embedding array, label): vec_id, n_links, component_id, kept.

    Vectors of equal label and length link where their cosine in double precision is at least ``cosine``.
    Null labels, ids and vectors, zero vectors and those with null or non-finite components link with
    nothing; their component is themselves. Equal vectors are one from the start and count with their
    number. Further columns are not read. Repeated ids are separate vectors of one component.

    Each group of a shared direction is cut into blocks by hash, and pairs of blocks are compared as
    matrices, so that no group is held whole and no list of pairs is made.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "label")
    fine = "vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0)"
    valid = rows.where(fine)
    reps = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    reps = stage(reps, "cap-vectors")
    sizes = reps.groupBy("label", F.size("embedding").alias("length")).count().groupBy("length").agg(F.max("count").alias("most")).collect()
    plans = {r["length"]: plan(r["most"], r["length"], cosine) for r in sizes}

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                lengths = np.array([len(v) for v in piece.column("embedding").to_pylist()])
                found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lengths)
                for length in np.unique(lengths):
                    own = np.flatnonzero(lengths == length)
                    for i, filters in zip(own, decode(_units(piece.column("embedding").take(pa.array(own))), *plans[length]), strict=True):
                        found[i] = filters
                yield pa.RecordBatch.from_arrays([piece.column("label"), piece.column("rep"), pa.array(lengths, pa.int32()), pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], ["label", "rep", "length", "filters"])

    label = f"label {rows.schema['label'].dataType.simpleString()}"
    decoded = stage(reps.select("label", "rep", "embedding").mapInArrow(f, f"{label}, rep long, length int, filters array<long>"), "cap-filters")
    members = decoded.select("label", "length", "rep", F.explode("filters").alias("filter"))
    shared = members.groupBy("label", "length", "filter").agg(F.count("*").alias("members")).where("members > 1")
    members = members.join(shared, ["label", "length", "filter"]).withColumn("blocks", F.expr(f"(members + {BLOCK} - 1) div {BLOCK}"))
    members = members.withColumn("block", F.expr("pmod(xxhash64(rep), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    members = members.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    members = members.join(decoded.select("label", "rep", "filters"), ["label", "rep"]).join(reps.select("label", "rep", "embedding", "weight"), ["label", "rep"])
    members = members.withColumn("key", F.concat_ws(":", F.col("label").cast("string"), "length", "filter", "first", "second"))

    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, "key"):
            links, roots = compare(group, cosine)
            ids = group["rep"].to_numpy()
            held = (links > 0) | (roots != ids)
            yield pa.RecordBatch.from_arrays([pa.array(x[held]) for x in (ids, links, roots)], ["rep", "links", "root"])

    grouped = members.select("key", "rep", "embedding", "weight", "filters", "filter", "first", "second", "block").repartition("key").sortWithinPartitions("key")
    found = stage(grouped.mapInArrow(g, "rep long, links long, root long"), "cap-links")
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("root").alias("src"), F.col("rep").alias("dst")))
    copies = valid.join(reps, ["label", "embedding"])
    copies = copies.select("vec_id", "rep", "weight").join(degree, "rep", "left").join(joined.toDF("rep", "joined"), "rep", "left")
    linked = copies.select("vec_id", F.expr("coalesce(links, 0) + weight - 1").alias("n_links"), F.coalesce("joined", "rep").alias("component_id"))
    alone = rows.where(f"NOT coalesce({fine}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_near_vectors(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
