"""N-gram Jaccard self-join by PartEnum signatures.

Sets of similar size share a band. Within a band a Jaccard bound is a bound k on the number of features in
which two sets differ. The feature domain (64-bit hashes) is cut into first-level partitions. Where there are more
than k, linked sets agree on some of them; where there are more than half as many, they differ in one feature
at most in some, and each is cut into second-level parts, of which the enumerated subsets leave out one. A set
has a signature for each subset, in its own band and in the next. There are more partitions than linked sets need, so they share several
signatures; each set may then leave out its thinnest and its most common ones, as many as still let one
shared signature stay. What shares a signature is compared by parity sketches, which never tell linked sets
apart, and verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import connected_components, free, hash_words, key_runs, mix, stage, text_slices

#: Words of a shingle in the contract's query; pipelines' stages take five words and 80.
WORDS, PERCENT = 4, 85
#: Signatures of a part of the shuffle, about: what a task sorts at a time.
PART = 1 << 21
#: Turns of verifying one center for each node before all that is left is verified.
TURNS = 3
#: Bound on differing features from which parts have no second level.
TWO_LEVELS = 16
#: Turns of comparing the groups that are left; only the last takes all their pairs, so the others come first.
LAST = 2
#: Nodes of a block; the nodes of a signature are compared block by block.
BLOCK = 2048
_HALF = np.uint64(0x5851F42D4C957F2D)
_NONE = np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; fewer words make one shingle, none an empty set."""
    h, at = hash_words(texts)

    def shingled(h: np.ndarray, size: int) -> np.ndarray:
        total = np.full(max(0, len(h) - size + 1), size, np.uint64)
        for i in range(size):
            total = mix(total + np.uint64(0x9E3779B97F4A7C15)) ^ h[i : len(h) - size + 1 + i]
        return mix(total)

    full = shingled(h, words)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(full[a : b - words + 1] if b - a >= words else shingled(h[a:b], b - a) if b > a else h[a:a]))
    return out


@lru_cache
def bands(percent: int, up_to: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """First and last set size of each band; linked sets are in one band or in neighbours."""
    first, last = [], []
    at = 1
    while at <= up_to:
        first.append(at)
        last.append(max(at, at * 100 // percent))
        at = last[-1] + 1
    return np.array(first), np.array(last)


@lru_cache(4096)
def plan(band: int, percent: int) -> tuple[int, int, int, int, int]:
    """(k, first, second, thin, common) of a band.

    k: the most features in which linked sets of the band differ, as |A| + |B| - 2 |A and B| <=
    (|A| + |B|) (100 - p) / (100 + p). Of ``first`` partitions linked sets differ in at most one feature in
    first - k // 2 or more, where second-level parts let one of them differ, and in none in first - k, where
    there is no second level; either number is 1 + thin + common, and they share a signature in each. Each
    set may therefore leave out its ``thin`` signatures with the fewest features, and of what is left the
    ``common`` ones that most sets have: both orders depend on what a signature holds only, so the last of
    the shared signatures in such an order stays on both sides. Small sets need the second level for their
    signatures to hold enough features. Where k is 0 only equal sets link, which need no signature.
    """
    k = 2 * int(bands(percent)[1][band]) * (100 - percent) // (100 + percent)
    if not k:
        return 0, 0, 0, 0, 0
    thin, common = -(-k // 8), -(-k // 16)
    return (k, k // 2 + 1 + thin + common, 4, thin, common) if k < TWO_LEVELS else (k, k + 1 + thin + common, 1, thin, common)


def signatures(h: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """(band, signatures) of a set in its own band and the next."""
    own = int(np.searchsorted(bands(percent)[1], len(h)))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ _HALF), out=sums[1:])
    out = []
    for band in (own, own + 1):
        _, first, second, thin, _ = plan(band, percent)
        if not first:
            continue
        parts = first * second
        edges = np.empty(parts + 1, np.int64)
        edges[0], edges[-1] = 0, len(h)
        edges[1:-1] = np.searchsorted(h, np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts))
        value, fill = sums[edges[1:]] - sums[edges[:-1]], np.diff(edges)
        if second > 1:
            # a subset is its partition without one of the partition's parts
            held, sizes = value.reshape(first, second), fill.reshape(first, second)
            value = (held.sum(1, dtype=np.uint64)[:, None] - held).ravel()
            fill = (sizes.sum(1)[:, None] - sizes).ravel()
        name = np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)
        found = mix(value ^ mix(name + np.uint64(1)))
        out.append((band, found[np.lexsort((found, fill))[thin:]]))
    return out


def set_id(h: np.ndarray) -> int:
    """A 64-bit id that equal sets share."""
    return int(mix(np.array([np.bitwise_xor.reduce(mix(h)) + np.uint64(len(h))])).view(np.int64)[0])


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the features that fall on each bit; four bits a feature or more, a power of two."""
    bits = max(64, 1 << (4 * len(h) - 1).bit_length())
    counts = np.bincount((mix(h ^ _HALF) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """A number of features that two sets differ in at least: the parities of their sketches that differ."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches):
            sets = shingle_sets(texts, words)
            new = [
                pa.array([len(h) for h in sets], pa.int64()),
                pa.array([set_id(h) if len(h) else None for h in sets], pa.int64()),
                pa.array([sketch(h).tobytes() if len(h) else None for h in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *new], ["doc_id", "n_shingles", "node", "sketch"])

    return docs.mapInArrow(f, "doc_id long, n_shingles long, node long, sketch binary")


def _pack(nodes: np.ndarray, bands_: np.ndarray, sigs: list[np.ndarray], parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, packed) of the signatures of sets: a head for each set with its number of signatures, six bytes each.

    A signature's lowest bit tells the set's own band from the next; its part and the other 47 bits its value.
    """
    every = np.concatenate(sigs)
    owner = np.repeat(np.arange(len(sigs)) // 2, [len(x) for x in sigs])
    bit = np.repeat(np.arange(len(sigs), dtype=np.uint64) % np.uint64(2), [len(x) for x in sigs])
    part, value = (every % np.uint64(parts)).astype(np.int32), (every // np.uint64(parts)) << np.uint64(1) | bit
    order = np.argsort(part, kind="stable")
    part, value, owner = part[order], value[order], owner[order]
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else [0]
    for a, b in zip(edges, edges[1:], strict=False):
        starts = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
        own = owner[a:b][starts]
        pieces = [np.int64(len(own)), nodes[own], np.diff(starts, append=b - a).astype(np.uint32), bands_[own].astype(np.uint16)]
        pieces += [value[a:b].astype(np.uint32), (value[a:b] >> np.uint64(32)).astype(np.uint16)]
        yield int(part[a]), b"".join(x.tobytes() for x in pieces)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, bands, values), a row for each signature."""
    n = int(np.frombuffer(packed, np.int64, 1)[0])
    nodes, counts = np.frombuffer(packed, np.int64, n, 8), np.frombuffer(packed, np.uint32, n, 8 + 8 * n).astype(np.int64)
    own, at, total = np.frombuffer(packed, np.uint16, n, 8 + 12 * n), 8 + 14 * n, int(counts.sum())
    low, high = np.frombuffer(packed[at : at + 4 * total], np.uint32), np.frombuffer(packed[at + 4 * total :], np.uint16)
    value = high.astype(np.uint64) << np.uint64(32) | low
    return np.repeat(nodes, counts), np.repeat(own, counts) + (value & np.uint64(1)).astype(np.int64), value >> np.uint64(1)


def _signed(docs: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """(part, packed): the signatures of many sets at a time, dealt to parts by their values.

    A task signs equal sets once, so copies bring no more signatures than there are tasks.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int] = set()
        for _, texts in text_slices(batches, rows=1024):
            fresh = {i: h for h in shingle_sets(texts, words) if len(h) for i in [set_id(h)] if i not in signed}
            if not fresh:
                continue
            signed.update(fresh)
            sets = list(fresh.values())
            own = np.searchsorted(bands(percent)[1], [len(h) for h in sets])
            sigs = []
            for band, h in zip(own.tolist(), sets, strict=True):
                found = dict(signatures(h, percent))
                sigs += [found.get(band, _NONE), found.get(band + 1, _NONE)]
            rows = list(_pack(np.array(list(fresh)), own, sigs, parts))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "packed"])

    return docs.select("text").mapInArrow(f, "part int, packed binary")


def _shared(signed: DataFrame, percent: int, parts: int) -> DataFrame:
    """(sig, node) of the signatures that several nodes have, less those that a node may leave out."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, ["part"]):
            node, band, sig = (np.concatenate(x) for x in zip(*map(_unpack, group["packed"].to_pylist()), strict=True))
            order = np.argsort(sig)
            ranked = sig[order]
            same = ranked[1:] == ranked[:-1]
            keep = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            keep = keep[np.lexsort((node[keep], sig[keep]))]
            node, band, sig = node[keep], band[keep], sig[keep]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            node, band, sig = node[new], band[new], sig[new]
            _, at, many = np.unique(sig, return_inverse=True, return_counts=True)
            several = np.flatnonzero(many[at] > 1)
            name = sig[several].astype(np.int64) * parts + group["part"][0].as_py()
            common = np.array([plan(b, percent)[4] for b in band[several].tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name, node[several], band[several], common, many[at][several])], ["sig", "node", "band", "common", "many"])

    dealt = signed.repartition("part").sortWithinPartitions("part")
    several = dealt.mapInArrow(f, "sig long, node long, band long, common long, many long")
    ranked = several.withColumn("rank", F.expr("row_number() over (partition by node, band order by many desc, sig)"))
    return ranked.where("rank > common").select("sig", "node")


def _whole_sets(docs: DataFrame, words: int) -> DataFrame:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches):
            sets = [h for h in shingle_sets(texts, words) if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "hashes"])

    return docs.select("text").mapInArrow(f, "node long, hashes binary")


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (center, node) those that sizes and sketches don't tell apart."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            rows = zip(batch.column("sketch_a"), batch.column("sketch_b"), strict=True)
            differ = np.array([apart(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in rows], np.int64)
            keep = pa.array(differ * (100 + percent) <= n * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("center", "node")], ["center", "node"])

    both = pairs.join(sketches.toDF("center", "n_a", "sketch_a"), "center").join(sketches.toDF("node", "n_b", "sketch_b"), "node")
    return both.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").mapInArrow(f, "center long, node long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (center, node) those whose sets are linked, as edges (src, dst)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # sets are read where the batch holds them
            rows = zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True)
            keep = pa.array([linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("center").filter(keep), batch.column("node").filter(keep)], ["src", "dst"])

    both = pairs.join(sets.toDF("node", "hashes_b"), "node").join(sets.toDF("center", "hashes_a"), "center")
    return both.mapInArrow(f, "src long, dst long")


def _across(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs (center, node) whose nodes are in different components."""
    both = pairs.join(joined.toDF("center", "a"), "center", "left").join(joined.toDF("node", "b"), "node", "left")
    return both.where("coalesce(a, center) <> coalesce(b, node)").select("center", "node")


def compare(group: pa.Table, percent: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): pairs of a group's nodes, of different components, that sizes and sketches don't tell apart.

    A group holds nodes of one signature, of one block or of two; pairs of two blocks are those across.
    The last turn takes all such pairs, others only as many as would join what those pairs join.
    """
    order = np.argsort(group["n"].to_numpy(), kind="stable")
    n, node, joined, block = (group[c].to_numpy()[order] for c in ("n", "node", "joined", "block"))
    two = group["low"][0].as_py() != group["high"][0].as_py()
    root, rank = joined.copy(), mix(node.view(np.uint64) + np.uint64(turn))
    held = [np.frombuffer(s, np.uint64) for s in group["sketch"].take(pa.array(order)).to_pylist()]
    width = np.array([len(s) for s in held])
    found_a, found_b = [node[:0]], [node[:0]]
    # sizes within the bound have sketches of one width or of neighbouring ones
    for w in np.unique(width):
        rows = np.flatnonzero((width == w) | (width == 2 * w))
        table = np.stack([s if len(s) == w else s[:w] ^ s[w:] for s in (held[i] for i in rows)])
        last = np.searchsorted(n[rows], n[rows] * 100 // percent, side="right")
        for i in np.flatnonzero(width[rows] == w).tolist():
            r, near = rows[i], rows[i + 1 : last[i]]
            fine = np.flatnonzero((root[near] != root[r]) & ((block[near] != block[r]) | (not two)))
            if not len(fine):
                continue
            near = near[fine]
            differ = np.bitwise_count(table[i + 1 : last[i]][fine] ^ table[i]).sum(1, dtype=np.int64)
            near = near[differ * (100 + percent) <= (n[near] + n[r]) * (100 - percent)]
            if not len(near):
                continue
            if turn < LAST:
                near = near[np.argsort(rank[near], kind="stable")]
                near = near[np.sort(np.unique(root[near], return_index=True)[1])]
                root[np.isin(root, root[near])] = root[r]
            found_a.append(np.full(len(near), node[r]))
            found_b.append(node[near])
    return np.concatenate(found_a), np.concatenate(found_b)


def _untried(shared: DataFrame, joined: DataFrame, sketches: DataFrame, percent: int, turn: int) -> DataFrame:
    """(sig, center, node): pairs of nodes that share a signature and are in different components, as compare() finds them.

    Signatures of the same nodes count once; of two nodes one was the other's center. Groups are cut into
    blocks by hash, and pairs of blocks are compared in tasks.
    """
    over = "over (partition by sig)"
    rows = shared.join(joined.toDF("node", "joined"), "node", "left").withColumn("joined", F.coalesce("joined", "node"))
    stats = {"low": f"min(joined) {over}", "high": f"max(joined) {over}", "many": f"count(*) {over}", "print": f"sum(cast(xxhash64(node) AS decimal(20))) {over}"}
    for name, expression in stats.items():
        rows = rows.withColumn(name, F.expr(expression))
    mixed = rows = stage(rows.where("low <> high AND many > 2").select("sig", "node", "joined", "many", "print"), "jaccard-mixed")
    once = rows.groupBy("print", "many").agg(F.min("sig").alias("sig")).select("sig")
    rows = rows.join(once, "sig", "left_semi").join(sketches, "node")
    rows = rows.withColumn("blocks", F.expr(f"(many + {BLOCK} - 1) div {BLOCK}")).withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, ["sig", "low", "high"]):
            a, b = compare(group, percent, turn)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), group["sig"][0].as_py())), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["sig", "center", "node"])

    key = ["sig", "low", "high"]
    dealt = rows.select(*key, "node", "joined", "block", "n", "sketch").repartition(*key).sortWithinPartitions(*key)
    found = stage(dealt.mapInArrow(f, "sig long, center long, node long"), "jaccard-untried")
    free(mixed)
    return found


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles and component_id.

    Two documents link when 100 * intersection >= percent * union of their sets of word shingles;
    component_id is the smallest doc_id reachable by links, itself included. Null or wordless texts
    have no shingles and link with nothing; a null doc_id is never linked and its component is null.
    Equal sets are one node from the start, so copies cost nothing further; a repeated doc_id is one
    vertex that has the links of all its texts. Other columns are not read. An empty table gives no rows.

    Each signature's nodes are compared with its center, one of them, which joins most of what belongs
    together. Where nodes of one signature are in several components after that, all its pairs across
    components are compared by sketches within tasks, so no link that joins components is missed whatever
    the size of the group, and only pairs that are linked or nearly so leave them.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = stage(_sets(docs, words), "jaccard-sets")
    named = found.where("node IS NOT NULL AND doc_id IS NOT NULL").select("node", "doc_id")
    first = named.groupBy("node").agg(F.min("doc_id").alias("first"))
    sketches = found.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    sketches = stage(sketches, "jaccard-sketches")
    same = named.groupBy("doc_id").agg(F.min("node").alias("src"), F.max("node").alias("dst")).where("src <> dst")
    same = named.join(same.select("doc_id", "src"), "doc_id").where("node <> src").select("src", F.col("node").alias("dst"))

    features = found.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffled, features // PART)
    shared = stage(_shared(_signed(docs.where("doc_id IS NOT NULL"), words, percent, parts), percent, parts), "jaccard-shared")
    center = shared.withColumn("c", F.expr("min(struct(xxhash64(node) AS key, node)) over (partition by sig)")).where("node <> c.node")
    close = stage(_close(center.select(F.col("c.node").alias("center"), "node").distinct(), sketches, percent), "jaccard-close")

    ends = close.select("node").union(close.select("center")).distinct()
    sets = stage(_read_sets(docs, ends, first, words), "jaccard-whole")
    links = first_links = stage(same, "jaccard-links")
    joined, held = connected_components(links), [found, sketches, first_links]
    for turn in range(TURNS):
        pairs = _across(close, joined) if turn else close
        if turn < TURNS - 1:
            pairs = pairs.groupBy("node").agg(F.expr(f"min_by(center, xxhash64(center, {turn}))").alias("center"))
        more = stage(_verified(pairs, sets, percent), "jaccard-links")
        held.append(more)
        if more.isEmpty():
            continue
        links, last = links.unionByName(more), joined
        joined = connected_components(links)
        free(last)
    free(sets)
    mixed = shared
    for turn in range(LAST + 1):
        left = _untried(mixed, joined, sketches, percent, turn)
        held.append(left)
        if left.isEmpty():
            break
        # groups without such a pair have none later on
        mixed = shared.join(left.select("sig").distinct(), "sig", "left_semi")
        pairs = left.select("center", "node").distinct()
        sets = stage(_read_sets(docs, pairs.select("node").union(pairs.select("center")).distinct(), first, words), "jaccard-whole")
        more = stage(_verified(pairs, sets, percent), "jaccard-links")
        free(sets)
        held.append(more)
        if not more.isEmpty():
            links, last = links.unionByName(more), joined
            joined = connected_components(links)
            free(last)
    free(shared, close)

    component = first.join(joined.toDF("node", "joined"), "node", "left").select("node", "first", F.coalesce("joined", "node").alias("joined"))
    least = component.groupBy("joined").agg(F.min("first").alias("component_id"))
    component = named.join(component.join(least, "joined"), "node").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = found.select("doc_id", "n_shingles").join(component, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = stage(out, "jaccard-components")
    free(joined, *held)
    return out


def _read_sets(docs: DataFrame, nodes: DataFrame, first: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of the nodes, from one document of each; a repeated doc_id may bring further nodes."""
    wanted = nodes.join(first, "node").select(F.col("first").alias("doc_id")).distinct()
    return _whole_sets(docs.join(wanted, "doc_id", "left_semi"), words).dropDuplicates(["node"])


def op8_jaccard_join(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of linked ones: that with the smallest doc_id, null last, and of equal ids
    that with the least hash.

    Rows are told apart by doc_id and text, so texts of a repeated doc_id, or without one, are kept unless
    they are linked; rows equal in both become one. Texts without words stay as they are, null included.
    """
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit("|"), "text")
    rows = docs.withColumn("__key", key)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = jaccard_components(rows.where(worded).select(F.col("__key").alias("doc_id"), "text"), words, percent)
    ids = rows.where(worded).select("__key", F.struct(F.col("doc_id").isNull(), "doc_id", "__key").alias("place"))
    kept = found.select(F.col("doc_id").alias("__key"), "component_id").distinct().join(ids, "__key")
    kept = kept.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.__key").alias("__key"))
    unlike = rows.where(worded).join(kept, "__key", "left_semi").dropDuplicates(["__key"])
    return unlike.select(docs.columns).unionByName(docs.where(~worded))
