"""Divergence of sources within each language, by SQL over shards.

Tasks count terms of whole texts in DuckDB; Spark adds the counts up and deals them out in shards by language
and term. DuckDB finds each shard's kept terms, then its share of the sums over pairs of sources and its own
best terms of each group; Spark adds the shares up and ranks.

A pair's sum runs over all kept terms of the language, but only counts that aren't 0 are ever held. With p0 the
share of a term that a group doesn't have, a pair's sum is that of |p - p0'| over the terms of either, what
terms of both correct, and |p0 - p0'| for all other terms.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import free, stage

#: Documents of a language that a kept term is in, parts of 1 in which shares are counted, and ranks of terms.
LEAST_DOCUMENTS, UNIT, RANKS = 30, 1_000_000_000, 50
#: What is added to each count.
PRIOR = 5
#: Bytes of text that DuckDB counts at a time, and rows of a shard; a shard ends with a term.
TEXT, SHARD = 4 << 20, 200_000
#: Groups of a language and source that are sent to every task at a time; more take further rounds.
GROUPS = 20_000

#: A-Z become a-z, then terms are runs of letters and of characters beyond ASCII.
UPPER, LOWER, TERM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

_GAP = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")

_COUNT = f"""
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs FROM (
  SELECT row, lang, source, term, count(*) AS n
  FROM (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM texts)
  GROUP BY ALL
) GROUP BY ALL
"""

_KEPT = f"""
SELECT lang, source, term, n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS lead FROM shard
QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {LEAST_DOCUMENTS}
"""

_SEEN = f"""
CREATE OR REPLACE TABLE seen AS
SELECT lang, source, term,
       (1 + ({UNIT}::HUGEINT * (n + {PRIOR})) // (total + {PRIOR} * terms))::BIGINT AS p,
       (1 + ({UNIT}::HUGEINT * {PRIOR}) // (total + {PRIOR} * terms))::BIGINT AS p0,
       (1 + ({UNIT}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + {PRIOR})) // (lang_total + {PRIOR} * terms))::BIGINT AS q
FROM shard
"""

_PAIRS = """
SELECT lang, least(source, item) AS a, greatest(source, item) AS b, sum(value)::HUGEINT::BIGINT AS value FROM (
  SELECT lang, s.source, o.source AS item, sum(abs(s.p - o.p0) * s.number) AS value
  FROM (SELECT lang, source, p, count(*) AS number FROM seen GROUP BY ALL) s JOIN groups o USING (lang)
  WHERE s.source <> o.source GROUP BY ALL
  UNION ALL
  SELECT lang, s.source, o.source AS item, sum(abs(s.p - o.p) - abs(s.p - o.p0) - abs(s.p0 - o.p) + abs(s.p0 - o.p0)) AS value
  FROM seen s JOIN seen o USING (lang, term) JOIN groups g ON g.lang = o.lang AND g.source = o.source
  WHERE s.source < o.source GROUP BY ALL
) GROUP BY ALL
"""

_TERMS = f"""
SELECT lang, source, term AS item, p - q AS value FROM seen WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {RANKS}
"""


def _database() -> duckdb.DuckDBPyConnection:
    """A database in memory, without files of its own."""
    return duckdb.connect(config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": False})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Rows (row, lang, source, text) of about TEXT bytes, and whether they end with the end of a text.

    A long text is cut between its terms; its pieces keep the number of the row.
    """
    row = 0
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        start = 0
        while start < len(size):
            end, held = start + 1, size[start]
            while end < len(size) and held + size[end] <= TEXT:
                held, end = held + size[end], end + 1
            rows = pa.Table.from_batches([batch.slice(start, end - start)]).append_column("row", pa.array(range(row, row + end - start)))
            if held <= TEXT:
                yield rows, True
            else:
                text, at = rows["text"][0].as_py(), 0
                while at < len(text):
                    gap = _GAP.search(text, at + TEXT // 4)
                    stop = gap.start() if gap else len(text)
                    yield rows.set_column(rows.column_names.index("text"), "text", pa.array([text[at:stop]])), stop == len(text)
                    at = stop
            row, start = row + end - start, end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with _database() as db:
        long: list[pa.Table] = []
        for texts, whole in _pieces(batches):
            db.register("texts", texts)
            found = db.execute(_COUNT).to_arrow_table()
            if not whole or long:
                # pieces of one text: their counts are added, and the text is one document
                long.append(found)
                if not whole:
                    continue
                db.register("pieces", pa.concat_tables(long))
                found = db.execute("SELECT lang, source, term, sum(n)::BIGINT AS n, 1::BIGINT AS docs FROM pieces GROUP BY ALL").to_arrow_table()
                db.unregister("pieces")
                long = []
            db.unregister("texts")
            yield from found.cast(_COUNTS).to_batches()


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in runs of about SHARD, each with all rows of its terms."""
    held: list[pa.RecordBatch] = []
    number = 0
    for batch in batches:
        if number >= SHARD and batch.num_rows:
            # the last term's rows, which may go on, stay
            table = pa.Table.from_batches(held).combine_chunks()
            lang, term = table["lang"][-1], table["term"][-1]
            last = pc.and_(pc.equal(table["lang"], lang), pc.equal(table["term"], term))
            cut = pc.index(last, True).as_py()
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            number = sum(b.num_rows for b in held)
        held.append(batch)
        number += batch.num_rows
    if number:
        yield pa.Table.from_batches(held)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with _database() as db:
        for rows in _shards(batches):
            db.register("shard", rows)
            yield from db.execute(_KEPT).to_arrow_table().cast(pa.schema([*(_COUNTS.field(c) for c in ("lang", "source", "term", "n")), ("lead", pa.bool_())])).to_batches()
            db.unregister("shard")


def _shares(groups: pa.Table, with_terms: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a shard gives: sums for pairs with one of these groups (b not null), and terms (b null)."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database() as db:
            db.register("given", groups)
            db.execute(f"CREATE TABLE groups AS SELECT lang, source, (1 + ({UNIT}::HUGEINT * {PRIOR}) // (total + {PRIOR} * terms))::BIGINT AS p0 FROM given WHERE terms > 0")
            for rows in _shards(batches):
                db.register("shard", rows)
                db.execute(_SEEN)
                yield from db.execute(f"SELECT lang, a, b, NULL::VARCHAR AS item, value FROM ({_PAIRS})").to_arrow_table().cast(schema).to_batches()
                if with_terms:
                    yield from db.execute(f"SELECT lang, source AS a, NULL::VARCHAR AS b, item, value FROM ({_TERMS})").to_arrow_table().cast(schema).to_batches()
                db.unregister("shard")

    return f


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of documents (text, lang, source).

    Null text, lang and source count as empty ones. Part ``pair``: how far apart a group of a language and
    source and each other source of the language are, farthest first. Part ``term``: the terms by which a group
    exceeds its language most, at most RANKS. Repeated rows are documents of their own; ties go by UTF-8 of
    the item; a language with one source has no pairs, one without kept terms has pairs of value 0. Without
    documents there is no row. Further columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = stage(counts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_kept, "lang string, source string, term string, n long, lead boolean"), "divergence-kept")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("number"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("lead").cast("long")).alias("terms"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total", "number", "lang_total", "terms")}
    groups = stage(texts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", *zero.values()), "divergence-groups")

    number = groups.count()
    small = F.broadcast if number <= GROUPS else lambda df: df
    rows = kept.select("lang", "source", "term", "n").join(small(groups.select("lang", "source", "total", "terms", "lang_total")), ["lang", "source"])
    rows = rows.repartition("lang", "term").sortWithinPartitions("lang", "term")
    rounds, parts, shares, skeleton = -(-number // GROUPS), [], [], []
    # in rounds over groups, so that tasks hold so many of them at most
    for turn in range(rounds):
        some = groups.where(F.expr(f"pmod(xxhash64(lang, source), {rounds}) = {turn}"))
        held = some.select("lang", "source", "total", "terms").toArrow()
        part = stage(rows.mapInArrow(_shares(held, turn == 0), "lang string, a string, b string, item string, value long"), "divergence-shares")
        parts.append(part)
        shares.append(part.where("b IS NOT NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
        other = some.select("lang", F.col("source").alias("b"), F.col("total").alias("b_total"), F.col("number").alias("b_number"))
        skeleton.append(groups.join(F.broadcast(other), "lang").where("source < b").select("lang", F.col("source").alias("a"), "b", "total", "b_total", "number", "b_number", "terms"))

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    if not rounds:
        return spark.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    p0 = lambda total: F.expr(f"CASE WHEN terms > 0 THEN 1 + {UNIT * PRIOR}L div ({total} + {PRIOR} * terms) ELSE 0 END")
    pairs = union(skeleton).join(union(shares).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), ["lang", "a", "b"], "left")
    pairs = pairs.withColumn("value", F.coalesce("value", F.lit(0)) + (F.col("terms") - F.col("number") - F.col("b_number")) * F.abs(p0("total") - p0("b_total")))
    pairs = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    pairs = pairs.withColumn("rank", F.expr("row_number() over (partition by lang, source order by value desc, item)"))
    terms = parts[0].where("b IS NULL").select("lang", F.col("a").alias("source"), F.lit("term").alias("part"), "item", "value")
    terms = terms.withColumn("rank", F.expr("row_number() over (partition by lang, source order by value desc, item)")).where(F.col("rank") <= RANKS)
    out = stage(pairs.unionByName(terms), "divergence")
    free(kept, groups, *parts)
    return out


def op13_divergence(docs: DataFrame) -> DataFrame:
    return audit(docs)


#: The same in DuckDB, dense: every group has every kept term.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT row, lang, source,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), vocabulary AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 30
), sizes AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM vocabulary GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * s.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (s.total + 5 * s.v)::HUGEINT AS q
  FROM groups g JOIN vocabulary k USING (lang) JOIN sizes s USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM dense WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
