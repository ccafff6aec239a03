"""Places of many terms at once: one pass over all texts with an automaton of the terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_NAMES = ["book", "volume", "source_file", "pdf_page"]


def finder(terms: list[str]) -> Callable[[str], list[tuple[int, int]]]:
    """A function that gives (number of the term, start) of all occurrences in a text, overlapping ones too."""
    machine = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        if term:
            machine.add_word(term, (*machine.get(term, ()), i))
    if not len(machine):
        return lambda text: []
    machine.make_automaton()
    return lambda text: [(i, end + 1 - len(terms[i])) for end, held in machine.iter(text) for i in held]


def term_places(pages: DataFrame, terms: list[str]) -> DataFrame:
    """book, volume, source_file, term (its number), length and start of all occurrences in volumes, overlapping ones too.

    Texts stay where they are and are read once, whatever the number of terms; only places found and the few
    characters at pages' edges are put in order, for occurrences that cross pages.
    """
    side = max(1, max(map(len, terms), default=0) - 1)
    hits = "array<struct<term:int,at:bigint>>"
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    own = ", ".join(f"{n} {kinds[n]}" for n in _NAMES)
    pairs = pa.list_(pa.struct([("term", pa.int32()), ("at", pa.int64())]))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(terms)
        for batch in batches:
            texts = batch.column("norm").to_pylist()
            found = pa.array([[{"term": i, "at": at} for i, at in find(t)] for t in texts], pairs)
            edges = [pa.array([len(t) for t in texts], pa.int64()), pa.array([t[:side] for t in texts]), pa.array([t[-side:] for t in texts])]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in _NAMES), *edges, found], [*_NAMES, "own", "head", "tail", "found"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(terms)
        for batch in batches:
            found = []
            for tail, following, size in zip(*(batch.column(n).to_pylist() for n in ("tail", "following", "own")), strict=True):
                # those that start on the page and end behind it
                met = find(tail + following) if following else []
                found.append([{"term": i, "at": size - len(tail) + at} for i, at in met if at < len(tail) < at + len(terms[i])])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("book", "volume", "source_file", "page_start", "found")), pa.array(found, pairs)], ["book", "volume", "source_file", "page_start", "found", "crossing"])

    rows = pages.where("norm <> ''").select(*_NAMES, "norm").mapInArrow(inside, f"{own}, own long, head string, tail string, found {hits}")
    order = Window.partitionBy("source_file").orderBy("pdf_page")
    rows = rows.withColumn("page_start", F.coalesce(F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("following", F.left(F.array_join(F.collect_list("head").over(order.rowsBetween(1, side)), ""), F.lit(side)))
    rows = rows.mapInArrow(across, f"book {kinds['book']}, volume {kinds['volume']}, source_file {kinds['source_file']}, page_start long, found {hits}, crossing {hits}")
    rows = rows.select("book", "volume", "source_file", "page_start", F.explode(F.concat("found", "crossing")).alias("x"))
    lengths = F.array(*[F.lit(len(t)) for t in terms]) if terms else F.array(F.lit(0))
    return rows.select("book", "volume", "source_file", F.col("x.term").alias("term"), F.get(lengths, F.col("x.term")).alias("length"), (F.col("page_start") + F.col("x.at")).alias("start"))
