"""Importance resampling towards a target distribution, over a persisted sparse count matrix.

Documents become rows of a sparse matrix of hashed 1- to 3-word features, kept as blocks of compressed sparse
rows (CSR). Column sums of the documents' and the target's matrices give two distributions and a gain for each
column; the matrix times the gains gives each document's weight. Weights with Gumbel noise are ranked, and the
best of them are a draw without replacement in proportion to the weights.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import free, stage

#: Columns of the matrix, words of the longest feature, words of a document that can be drawn, and percent drawn.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of text that make a block of rows; a longer text is a block of its own and is counted in pieces of as many.
BLOCK = 1 << 20

#: A-Z as a-z, all bytes that no word holds as blanks.
_WORDS = bytes((b | 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

#: Blocks that are written, and so read, at a time: Spark reads up to 4096 rows of a row group at once.
GROUP = 8

_BLOCKS = "doc_ids array<long>, n_words array<long>, row_ends binary, steps binary, counts binary"


def _grams(words: list[bytes]) -> list[np.ndarray]:
    """Buckets of the features of 1, 2 .. LONGEST words that start at each word; crc32 goes on where the shorter one ended."""
    values, out = list(map(crc32, words)), []
    for n in range(LONGEST):
        if n:
            values = list(map(crc32, words[n:], map(crc32, repeat(b" "), values)))
        out.append(np.array(values, np.int64) % BUCKETS)
    return out


def _rows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, row * BUCKETS + bucket of the entries in order, counts) of short texts, hashed together."""
    split = [t.translate(_WORDS).split() for t in texts]
    numbers = np.array([len(w) for w in split], np.int64)
    words = [w for each in split for w in each]
    row, left = np.repeat(np.arange(len(texts)), numbers), np.repeat(np.cumsum(numbers), numbers) - np.arange(len(words))
    keys = [row[: len(g)][whole] * BUCKETS + g[whole] for n, g in enumerate(_grams(words)) for whole in [left[: len(g)] > n]]
    return numbers, *np.unique(np.concatenate(keys), return_counts=True)


def _row_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of one long text, in pieces that end between words and start with the last words of the piece before."""
    held: list[bytes] = []
    number, sums, at = 0, np.zeros(BUCKETS, np.int64), 0
    while at < len(text):
        gap = _GAP.search(text, at + BLOCK)
        end = gap.start() if gap else len(text)
        fresh = text[at:end].translate(_WORDS).split()
        words = held + fresh
        for n, buckets in enumerate(_grams(words)):
            sums += np.bincount(buckets[max(0, len(held) - n) :], minlength=BUCKETS)
        held, number, at = words[-(LONGEST - 1) :], number + len(fresh), end
    found = np.flatnonzero(sums)
    return np.array([number]), found, sums[found]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        ids = batch.column("doc_id")
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            # rows until the block is full, one row at least
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK, side="right")))
            held = [b or b"" for b in texts.slice(start, end - start).cast(pa.binary()).to_pylist()]
            numbers, keys, counts = _row_of(held[0]) if len(held) == 1 else _rows_of(held)
            row_ends = np.searchsorted(keys, np.arange(1, len(held) + 1) * BUCKETS)
            # columns as steps from the one before, which take less on disk
            columns = keys % BUCKETS
            steps = np.diff(columns, prepend=0)
            first = np.concatenate([[0], row_ends[:-1]])
            first = first[first < row_ends]
            steps[first] = columns[first]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_ids": [ids.slice(start, end - start).to_pylist()],
                    "n_words": [numbers.tolist()],
                    "row_ends": [row_ends.astype(np.int64).tobytes()],
                    "steps": [steps.astype(np.uint16).tobytes()],
                    "counts": [counts.astype(np.int32).tobytes()],
                },
                pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("row_ends", pa.binary()), ("steps", pa.binary()), ("counts", pa.binary())]),
            )
            start = end


def count_matrix(texts: DataFrame, id_column: str, name: str) -> DataFrame:
    """The sparse matrix of texts (id, text), as a staged table of CSR blocks.

    A block has the ids and numbers of words of its rows, and for its entries the ends of rows, the columns
    (each as the step from the one before it in its row) and the counts.
    """
    rows = texts.select(F.col(id_column).cast("long").alias("doc_id"), "text")
    return stage(rows.mapInArrow(_blocks, _BLOCKS), name, compression="zstd", **{"parquet.block.row.count.limit": str(GROUP)})


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Each block with its rows' ends, columns and counts."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = {c: batch.column(c)[i] for c in ("doc_ids", "n_words", "row_ends", "steps", "counts")}
            ends, steps, counts = (np.frombuffer(block[c].as_buffer(), t) for c, t in (("row_ends", np.int64), ("steps", np.uint16), ("counts", np.int32)))
            sums = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
            starts = np.concatenate([[0], ends[:-1]])
            yield block, ends, sums[1:] - np.repeat(sums[starts], ends - starts), counts.astype(np.int64)


def column_sums(matrix: DataFrame) -> np.ndarray:
    """The features in each column, summed in tasks first: BUCKETS numbers come to the driver at any size."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for _, _, columns, counts in _entries(batches):
            # sums of doubles are exact below 2 ** 53
            sums += np.bincount(columns, counts, BUCKETS).astype(np.int64)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in matrix.mapInArrow(f, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which each column is likelier in the target, one more of each counted."""
    here, there = float(documents.sum()), float(target.sum())
    return np.array([floor(1000 * log((t + 1) * (here + BUCKETS) / ((s + 1) * (there + BUCKETS)))) for s, t in zip(documents.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variable that a hash of the id fixes."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


def weighted(matrix: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row: blocks times the gains, in whole numbers."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ends, columns, counts in _entries(batches):
            starts = np.concatenate([[0], ends[:-1]])
            product, numbers = (np.concatenate([[0], np.cumsum(x)]) for x in (gain[columns] * counts, counts))
            weight = product[ends] - product[starts]
            ids = block["doc_ids"].as_py()
            score = weight + np.array([noise(i, seed) for i in ids], np.int64)
            columns = [pa.array(ids, pa.int64()), block["n_words"].values, pa.array(numbers[ends] - numbers[starts]), pa.array(weight), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    return matrix.mapInArrow(f, "doc_id long, n_words long, n_features long, weight long, score long")


def numbered(df: DataFrame, *order, name: str) -> DataFrame:
    """df, staged, with rank: 1, 2, 3.. in this order, by ranges that are sorted and counted apart."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id())
    placed = stage(placed, name)
    part = F.shiftright("rank", 33)
    # one number for each range comes to the driver
    before, found = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        found.append((r["part"], before))
        before += r["count"]
    starts = F.broadcast(df.sparkSession.createDataFrame(found, "part long, before long"))
    ranked = placed.join(starts, part == F.col("part")).withColumn("rank", F.col("rank").bitwiseAND((1 << 33) - 1) + F.col("before") + 1)
    return ranked.drop("part", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_features, weight, score, rank, all long.

    target has texts of the wanted distribution. Words are runs of digits, a-z and characters beyond ASCII, A-Z
    lower-cased; features are runs of 1 to 3 words, repeats counted. rank is null for documents that aren't
    drawn. Null texts have no words: weight 0, and the score is the noise alone. A null doc_id counts as an
    empty one and comes after others at ties. Repeated rows are drawn as rows of their own; rows of one
    doc_id share their noise, and at ties go by features, then weight. Without documents there is no row,
    without target texts all gains come from the documents alone. Further columns are not read.
    """
    matrix, wanted = count_matrix(docs, "doc_id", "importance-matrix"), count_matrix(target.withColumn("item", F.lit(None).cast("long")), "item", "importance-target")
    gain = gains(column_sums(matrix), column_sums(wanted))
    free(wanted)
    scored = stage(weighted(matrix, gain, seed), "importance-scores")
    free(matrix)
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = percent * fit.count() // 100
    order = F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")
    ranked = numbered(fit, *order, name="importance-ranks")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark)
