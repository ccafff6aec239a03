"""Helpers the operators share: staged tables, whole-text batches and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a batch that a Python task holds as Python objects at a time.
SLICE_ROWS = 256
#: Bytes of text that it holds at a time, where one text isn't longer.
SLICE_BYTES = 4 << 20
#: Bytes of text that are hashed together.
PIECE = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a single machine, where none is set, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_staged: ContextVar[list[DataFrame] | None] = ContextVar("staged", default=None)


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Owns the tables that are staged within and frees them at its end, but those given to what it yields."""
    outer, own = _staged.get(), []
    token = _staged.set(own)

    def kept(df: DataFrame) -> DataFrame:
        own[:] = [x for x in own if x is not df]
        if outer is not None:
            outer.append(df)
        return df

    try:
        yield kept
    finally:
        _staged.reset(token)
        free(*own)


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.staged_at = path
    owner = _staged.get()
    if owner is not None:
        owner.append(held)
    return held


def free(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = SLICE_ROWS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Small pieces of each batch with the UTF-8 bytes of a text column (null: empty): so many rows, or fewer of long texts."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right"))
            end = max(at + 1, min(at + rows, full))
            piece, at = batch.slice(at, end - at), end
            yield piece, [b or b"" for b in piece.column(column).cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; bytes methods know ASCII only."""
    return text.lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random number for each byte at each of 64 places of a word; the same in every process.
_PLACED = np.random.default_rng(11).integers(0, 1 << 64, (64, 256), np.uint64).ravel()
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a piece's words, from sums of each byte's number at its place, and where the words start."""
    b = np.frombuffer(data.lower(), np.uint8)
    word = (b != 32) & ((b < 9) | (b > 13))
    at = np.flatnonzero(word)
    if not len(at):
        return np.zeros(0, np.uint64), at
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    lengths = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    values = _PLACED[((place & 63) << 8) | b[at]]
    if lengths.max() > 64:
        far = np.flatnonzero(place > 63)
        values[far] = mix(values[far] + (place[far] >> 6).astype(np.uint64))
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)), at[first]


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, as words_of() cuts them, and where each text's words begin and end.

    The same in every process. Texts are hashed together, a long one in pieces that end at white space.
    """
    hashes, numbers = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    held: list[bytes] = []

    def flush(upto: int) -> None:
        if held:
            h, starts = _hash_piece(b"\n".join(held))
            ends = np.cumsum([len(t) + 1 for t in held])
            hashes.append(h)
            numbers[upto - len(held) : upto] = np.diff(np.searchsorted(starts, ends), prepend=0)
            held.clear()

    size = 0
    for i, text in enumerate(texts):
        if len(text) > PIECE:
            flush(i)
            size, at = 0, 0
            while at < len(text):
                cut = _SPACE.search(text, at + PIECE)
                end = cut.start() if cut else len(text)
                h, _ = _hash_piece(text[at:end])
                hashes.append(h)
                numbers[i] += len(h)
                at = end
            continue
        held.append(text)
        size += len(text)
        if size > PIECE:
            flush(i + 1)
            size = 0
    flush(len(texts))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(numbers)])


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of df with further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (n) over the least threshold that at most ``most`` rows exceed, ties left out together.

    The threshold comes from a histogram over powers of 1.02, so no task and no driver sorts or holds
    more rows than are wanted. Where already the most frequent rows are more than that, as in small tables whose
    words are all as rare, the first of them by number and then by the other columns are taken.
    """
    step = F.floor(F.log("n") / F.log(F.lit(1.02)))
    sizes = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, least = 0, None
    for at, number in sizes:
        total += number
        if total > most:
            break
        least = at
    if least is not None:
        return counts.where(step >= F.lit(least))
    top = counts.where(step == F.lit(sizes[0][0])) if sizes else counts
    return top.orderBy(F.desc("n"), *(c for c in counts.columns if c != "n")).limit(most)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component_id): the smallest id reachable from each end of an edge (src, dst).

    Rounds of taking the neighbours' smallest label and then the label's own label; each round
    is a staged table, and hot vertices are reduced map-side before the shuffle. Stops when no
    label changes, so the result is exact whatever the number of rounds. The result is a staged table.
    """
    both = stage(
        edges.select("src", "dst").where("src <> dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src <> dst")).distinct(),
        "edges",
    )
    labels = stage(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("id")).alias("component_id")), "labels")
    last = labels
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "component_id"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component_id").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("component_id").alias("before"), F.least("component_id", "near").alias("hooked"))
        jump = labels.select(F.col("id").alias("hooked"), F.col("component_id").alias("jumped"))
        moved = stage(
            hooked.join(jump, "hooked").select("id", F.col("jumped").alias("component_id"), (F.col("jumped") < F.col("before")).alias("moved")),
            "labels",
        )
        free(last)
        labels, last = moved.select("id", "component_id"), moved
        if moved.where("moved").isEmpty():
            free(both)
            labels.staged_at = moved.staged_at
            return labels
