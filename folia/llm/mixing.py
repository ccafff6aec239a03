"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is cut into blocks of equal runs of words of its shuffled documents, and has as many slots as bring
the words of its blocks nearest to its target. The slots of all sources, one after another, are a grid; the van der
Corput sequence visits every point of it once, and a point falls, through the cumulative numbers of slots, to a
source. Slot r of a source, ranked by when the sequence comes to it, takes block r modulo its number of blocks.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import stage

#: Weights of the sources in code point order, repeating; null last.
WEIGHTS = (3, 1, 2)
#: Words of the mix against the words of all sources, and of a source's target against its own.
SHARE, MOST = 1.5, 2.0
#: Blocks of a source, at most; a block has a word at least.
BLOCKS = 1 << 12
#: More sources than this are refused: their totals come to the driver.
MAX_SOURCES = 100_000
#: Hash ranges of a source in which its documents are ordered independently.
RANGES = 4096

WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words of the mix for each source: by weight, at most ``most`` times its size.

    What a source can't take is shared anew by weight among those below their limit.
    """
    total, limit = share * sum(sizes), [most * s for s in sizes]
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(limit[i] for i in full)
        weights_left = sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] / weights_left > limit[i]]
        if not over:
            return [limit[i] if i in full else left * weight[i] / weights_left for i in range(len(sizes))]
        full.update(over)


def slots_of(size: int, target: float, block: int) -> int:
    """The slots whose blocks, in turn and the last one with what is left, hold words nearest to the target."""
    if not size:
        return 0
    blocks, whole = -(-size // block), int(target // size)
    return whole * blocks + min(blocks, floor((target - whole * size) / block + 0.5))


def mix_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, blocks: int = BLOCKS
) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken.

    size: words of the text (null: 0). taken: words that the mix takes of the document, repeats counted,
    at most ``most`` times its size. What a source's documents give differs from its target by half a block at
    most, which is half a word for sources of up to ``blocks`` words. Sources are shuffled by a hash of doc_id, so
    reruns agree; rows of one doc_id and size are interchangeable. Null doc_ids are shuffled like any other. A
    source without words, or an empty table, has target 0 and takes nothing. A column __row, where docs has one, is
    kept and orders rows of one doc_id and size; docs then have __mark too, by which rows without doc_id are shuffled.
    """
    keys = [c for c in docs.columns if c == "__row"]
    name = F.coalesce(F.col("doc_id").cast("string"), *(F.col("__mark") for _ in keys), F.lit(""))
    sized = stage(
        docs.select(
            "doc_id",
            *keys,
            "source",
            F.coalesce(F.expr(f"regexp_count(text, r'{WORDS}')"), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit("mix:"), name).cast("binary")).alias("place"),
        ),
        "mix-sizes",
    )
    spark = docs.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    first, rows = 0, []
    for r, target in zip(found, targets(sizes, weights, share, most), strict=True):
        block = max(1, -(-r["size"] // blocks))
        slots = slots_of(r["size"], target, block)
        rows.append((r["source"], r["size"], float(target), block, -(-r["size"] // block), first, slots))
        first += slots
    sources = spark.createDataFrame(rows, "source string, source_size long, target double, block_size long, n_blocks long, first long, slots long")

    # the schedule: a grid of 2 ** bits points, of which the sequence's i-th is i with its bits in reverse
    bits = max(1, first.bit_length())
    turn = F.expr(f"cast(conv(reverse(lpad(bin(first + at), {bits}, '0')), 2, 10) AS long)")
    slots = sources.where("slots > 0").select("source", "n_blocks", "first", F.explode(F.expr("sequence(0L, slots - 1)")).alias("at"))
    ranked = slots.withColumn("turn", turn).withColumn("slot", F.expr("row_number() over (partition by source order by turn) - 1"))
    taken = ranked.groupBy("source", F.expr("slot % n_blocks").alias("block")).agg(F.count("*").alias("times"))

    # where each document lies in its source's shuffled words
    placed = sized.withColumn("range", F.conv(F.substring("place", 1, 3), 16, 10).cast("int") % RANGES)
    offset = placed.groupBy("source", "range").agg(F.sum("size").alias("n"))
    offset = offset.select("source", "range", F.expr("coalesce(sum(n) over (partition by source order by range rows between unbounded preceding and 1 preceding), 0)").alias("offset"))
    within = placed.withColumn("start", F.expr(f"sum(size) over (partition by source, range order by {', '.join(['place', 'doc_id', 'size', *keys])} rows between unbounded preceding and current row) - size"))
    within = within.alias("d").join(offset.alias("o"), F.expr("d.source <=> o.source AND d.range = o.range"))
    within = within.select("d.doc_id", *keys, "d.source", "d.size", "d.place", (F.col("start") + F.col("offset")).alias("start"))
    within = within.alias("d").join(F.broadcast(sources).alias("s"), F.expr("d.source <=> s.source")).select("d.*", "source_size", "target", "block_size")

    pieces = within.where("size > 0").withColumn("block", F.explode(F.expr("sequence(start div block_size, (start + size - 1) div block_size)")))
    pieces = pieces.withColumn("part", F.expr("least(start + size, (block + 1) * block_size) - greatest(start, block * block_size)"))
    pieces = pieces.alias("d").join(taken.alias("t"), F.expr("d.source <=> t.source AND d.block = t.block"), "left")
    pieces = pieces.select("d.source", "d.start", "d.doc_id", *keys, "d.size", "source_size", "target", F.expr("part * coalesce(times, 0)").alias("words"))
    row = ["doc_id", *keys, "size", "source_size", "target"]
    mixed = pieces.groupBy("source", "start", *row).agg(F.sum("words").alias("taken"))
    return mixed.select(*row, "taken").unionByName(within.where("size = 0").select(*row, F.lit(0).cast("long").alias("taken")))


def op7_mixing(docs: DataFrame) -> DataFrame:
    return mix_documents(docs)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, rounded to whole documents.

    Each row has its own number of copies, with a doc_id or without; documents without words hold nothing
    to mix and are left out.
    """
    # documents as one column: names of their own clash with nothing
    rows = stage(docs.select(F.struct("*").alias("doc"), "doc_id", "text", "source", F.monotonically_increasing_id().alias("__row")), "mix-rows")
    named = rows.where("doc_id IS NOT NULL").select("doc_id", "__row", "text", "source", F.lit(None).cast("string").alias("__mark"))
    taken = mix_documents(named.unionByName(_marked(rows.where("doc_id IS NULL")))).where("size > 0")
    taken = taken.select("__row", F.expr("cast(floor(taken / size + 0.5D) AS INT)").alias("copies")).where("copies > 0")
    return rows.select("doc", "__row").join(taken, "__row").select("doc", F.explode(F.expr("sequence(1, copies)"))).select("doc.*")


def _marked(rows: DataFrame) -> DataFrame:
    """rows with __mark: the hash of the text, and a number among the rows of one text and source.

    Ranked in two levels, so that a text of many rows isn't one task's.
    """
    rows = rows.select("doc_id", "__row", "text", "source", F.sha2("text", 256).alias("hash"), F.expr("__row div 8192").alias("stripe"))
    before = rows.groupBy("source", "hash", "stripe").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.expr("coalesce(sum(n) over (partition by source, hash order by stripe rows between unbounded preceding and 1 preceding), 0)"))
    ranked = rows.withColumn("r", F.expr("row_number() over (partition by source, hash, stripe order by __row)"))
    ranked = ranked.alias("d").join(before.alias("b"), F.expr("d.source <=> b.source AND d.hash <=> b.hash AND d.stripe = b.stripe"))
    return ranked.select("d.doc_id", "d.__row", "d.text", "d.source", F.concat_ws(":", "d.hash", F.col("r") + F.col("before")).alias("__mark"))


#: The same mix in DuckDB. Saturated sources are those whose limit over weight is least.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most, pos,
         CASE (pos - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM totals)
), ratio AS (
  SELECT *, row_number() OVER (ORDER BY most / weight, pos) AS k,
         coalesce(sum(most) OVER (ORDER BY most / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(weight) OVER (ORDER BY most / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
  FROM weighed
), cut AS (
  SELECT k AS cut_k, total - full_before AS words_left, weights_left FROM ratio
  WHERE (total - full_before) * weight / weights_left <= most ORDER BY k LIMIT 1
), aimed AS (
  SELECT source, source_size, pos,
         CASE WHEN k < cut_k THEN most ELSE words_left * weight / cut.weights_left END AS target
  FROM ratio, cut
), cut_up AS (
  SELECT *, CAST(greatest(1, ceil(source_size / 4096::DOUBLE)) AS BIGINT) AS block FROM aimed
), slotted AS (
  SELECT *, CAST(ceil(source_size / block) AS BIGINT) AS n_blocks,
         CASE WHEN source_size = 0 THEN 0
              ELSE CAST(floor(target / source_size) AS BIGINT) * CAST(ceil(source_size / block) AS BIGINT)
                   + least(CAST(ceil(source_size / block) AS BIGINT), CAST(floor((target - floor(target / source_size) * source_size) / block + 0.5) AS BIGINT)) END AS slots
  FROM cut_up
), sources AS (
  SELECT *, CAST(sum(slots) OVER (ORDER BY pos) - slots AS BIGINT) AS first, length(bin(CAST(sum(slots) OVER () AS BIGINT))) AS bits FROM slotted
), points AS (
  SELECT pos, n_blocks, bits, unnest(range(first, CAST(first + slots AS BIGINT))) AS nth FROM sources
), slots AS (
  SELECT pos, n_blocks, row_number() OVER (PARTITION BY pos ORDER BY reverse(lpad(bin(nth), CAST(bits AS INTEGER), '0'))) - 1 AS slot FROM points
), taken AS (
  SELECT pos, slot % n_blocks AS block_no, count(*) AS times FROM slots GROUP BY ALL
), placed AS (
  SELECT doc_id, source, size,
         sum(size) OVER (PARTITION BY source ORDER BY substr(place, 1, 3), place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized
), pieces AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.pos, s.block, d.start,
         unnest(CASE WHEN d.size = 0 THEN [-1] ELSE range(CAST(d.start // s.block AS BIGINT), CAST((d.start + d.size - 1) // s.block + 1 AS BIGINT)) END) AS block_no
  FROM placed d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST(sum(CASE WHEN p.size = 0 THEN 0
                     ELSE (least(p.start + p.size, (p.block_no + 1) * p.block) - greatest(p.start, p.block_no * p.block)) * coalesce(t.times, 0) END) AS BIGINT) AS taken
FROM pieces p LEFT JOIN taken t ON p.pos = t.pos AND p.block_no = t.block_no
GROUP BY p.doc_id, p.size, p.source_size, p.target, p.pos, p.start
"""
