"""Alignment of whole volumes with their authority: unique grams as anchors, their best chain, comparison between cuts.

A volume is never put together: positions count over its kept characters, and a piece of work is cut out of pieces of
fixed length. Only runs of anchors, one for each insertion or omission, are chained in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.session import written

#: What is compared: Chinese characters.
HAN = "[一-鿿]"
#: Characters of an anchor; one in how many of a text's grams can be one; characters of a piece, of a part of a run, and of a stretch.
GRAM, DENSITY, PIECE, PART, STRETCH = 12, 16, 1024, 4096, 4096
#: Longest substitution, and characters about it that are told.
LONGEST, ABOUT = 2, 3
_EDGE = LONGEST + ABOUT


def placed(units: DataFrame, member: str = HAN) -> DataFrame:
    """volume, unit, text (of characters of a class only) and at, its place in the volume; units are in order of unit."""
    own = units.select("volume", "unit", F.regexp_replace(F.coalesce("text", F.lit("")), member.replace("[", "[^", 1), "").alias("text"))
    before = Window.partitionBy("volume").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.select("volume", "unit", F.length("text").alias("n")).select("volume", "unit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    return own.join(sizes.hint("merge"), ["volume", "unit"])


def _grams(texts: DataFrame, at: str) -> DataFrame:
    """Chosen grams of volumes, by hash, and where. A hash that lies costs an anchor, no result: texts are compared."""
    # a place in a text is found by walking there, so long texts are cut first
    cut = F.expr(f"if(length(text) < {GRAM}, array(), transform(sequence(1, length(text) - {GRAM - 1}, {STRETCH}), p -> struct(at + p - 1 AS at, substring(text, p, {STRETCH + GRAM - 1}) AS text)))")
    stretches = texts.select("volume", F.explode(cut).alias("s")).select("volume", "s.at", "s.text")

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = [(at, h, np.flatnonzero(h % np.uint64(DENSITY) == 0)) for at, h in ((at, _hashes(text)) for at, text in zip(frame["at"], frame["text"], strict=True))]
            if kept:
                grams, places = np.concatenate([h[c] for _, h, c in kept]).view(np.int64), np.concatenate([at + c for at, _, c in kept])
                yield pd.DataFrame({"volume": np.repeat(frame["volume"].to_numpy(), [len(c) for _, _, c in kept]), "gram": grams, at: places})

    return stretches.mapInPandas(f, f"volume {texts.schema['volume'].dataType.simpleString()}, gram long, {at} long")


def _hashes(text: str) -> np.ndarray:
    """A hash of each gram of a text: a polynomial over its characters, mixed."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = len(codes) - GRAM + 1
    total = np.zeros(size, np.uint64)
    for k in range(GRAM):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + size]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ total >> np.uint64(29)


def runs(ocr: DataFrame, authority: DataFrame) -> DataFrame:
    """volume, a, b (exclusive), shift and n: neighbouring anchors with one shift, as places of the first text."""
    # anchors stand once on each side
    both = _grams(ocr, "i").unionByName(_grams(authority, "j"), allowMissingColumns=True)
    once = both.groupBy("volume", "gram").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.count("i").alias("n"), F.count("j").alias("m")).where("n = 1 AND m = 1 AND volume IS NOT NULL")
    anchors = once.select("volume", "i", (F.col("j") - F.col("i")).alias("shift"))
    order = Window.partitionBy("volume").orderBy("i")
    new = F.coalesce((F.lag("shift").over(order) != F.col("shift")).cast("int"), F.lit(1))
    numbered = anchors.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("volume", "run").agg(F.min("i").alias("a"), (F.max("i") + GRAM).alias("b"), F.first("shift").alias("shift"), F.count("*").alias("n")).drop("run")


def chained(found: DataFrame) -> DataFrame:
    """The runs of a volume's heaviest chain in which both texts rise; of equal ones the one met first.

    Heaviest chains by where they end are held in a tree of maxima.
    """

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["a", "shift"], ignore_index=True)
        starts, ends = (frame["a"] + frame["shift"]).to_numpy(), (frame["b"] + frame["shift"]).to_numpy()
        ranks = {e: r + 1 for r, e in enumerate(sorted(set(ends)))}
        keys = sorted(ranks)
        tree, last, total = [(0, -1)] * (len(keys) + 1), [-1] * len(frame), [0] * len(frame)
        for x in range(len(frame)):
            # anchors of different runs may overlap by less than a gram: the cut between them is then empty
            r, best = _below(keys, starts[x] + GRAM - 1), (0, -1)
            while r:
                best, r = max(best, tree[r], key=lambda t: t[0]), r & (r - 1)
            total[x], last[x] = best[0] + int(frame["n"][x]), best[1]
            r = ranks[ends[x]]
            while r < len(tree):
                if total[x] > tree[r][0]:
                    tree[r] = (total[x], x)
                r += r & -r
        kept, x = [], max(range(len(frame)), key=lambda y: total[y])
        while x >= 0:
            kept.append(x)
            x = last[x]
        return frame.iloc[sorted(kept)]

    return found.groupBy("volume").applyInPandas(f, found.schema)


def _below(keys: list[int], most: int) -> int:
    low, high = 0, len(keys)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if keys[middle] <= most else (low, middle)
    return low


def work(chain: DataFrame, ocr: DataFrame, authority: DataFrame) -> DataFrame:
    """volume, a, b, c, d, own_a, own_b: what to compare, places a to b of the first text with c to d of the second.

    Runs are cut into parts, which overlap by what a substitution needs about it; gaps between runs, before the first
    and after the last, take in an anchor on both sides. Substitutions count where they begin in own_a to own_b.
    """
    order = Window.partitionBy("volume").orderBy("a")
    ends = ocr.groupBy("volume").agg(F.max(F.expr("at + length(text)")).alias("size")).join(authority.groupBy("volume").agg(F.max(F.expr("at + length(text)")).alias("other")).hint("merge"), "volume")
    rows = chain.withColumn("b0", F.lag("b").over(order)).withColumn("s0", F.lag("shift").over(order)).withColumn("final", F.lead("a").over(order).isNull()).join(ends.hint("merge"), "volume")
    cuts = rows.select("volume", "a", "b", "shift", F.explode(F.expr(f"sequence(a, b - 1, CAST({PART} AS BIGINT))")).alias("own_a"))
    cuts = cuts.withColumn("own_b", F.expr(f"least(own_a + {PART}, b)"))
    parts = cuts.selectExpr("volume", f"greatest(own_a - {_EDGE}, a) AS x", f"least(own_b + {_EDGE}, b) AS y", "shift", "own_a", "own_b").selectExpr("volume", "x AS a", "y AS b", "x + shift AS c", "y + shift AS d", "own_a", "own_b")
    head = f"b0 IS NULL, 0L, b0 - {GRAM}"
    gaps = rows.selectExpr("volume", f"if({head}) AS a", f"a + {GRAM} AS b", f"if(b0 IS NULL, 0L, b0 + s0 - {GRAM}) AS c", f"a + shift + {GRAM} AS d", "coalesce(b0, 0L) AS own_a", "a AS own_b")
    tails = rows.where("final").selectExpr("volume", f"b - {GRAM} AS a", "size AS b", f"b + shift - {GRAM} AS c", "other AS d", "b AS own_a", "size AS own_b")
    return parts.unionByName(gaps).unionByName(tails).where("own_a < own_b")


def _pieces(texts: DataFrame) -> DataFrame:
    """volume, piece and text: volumes in pieces of one length."""
    numbers = F.expr(f"if(text = '', array(), sequence(at div {PIECE}, (at + length(text) - 1) div {PIECE}))")
    rows = texts.select("volume", "at", "text", F.explode(numbers).alias("piece"))
    cut = rows.selectExpr("volume", "piece", f"greatest(at, piece * {PIECE}) AS p", f"substring(text, CAST(greatest(piece * {PIECE} - at, 0L) + 1 AS INT), CAST((piece + 1) * {PIECE} - greatest(at, piece * {PIECE}) AS INT)) AS part")
    return cut.groupBy("volume", "piece").agg(F.expr("array_join(transform(array_sort(collect_list(struct(p, part))), x -> x.part), '')").alias("text"))


def _cut_out(wanted: DataFrame, texts: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the text from a to b to numbered rows."""
    needed = wanted.select("volume", "id", F.col(a).alias("a"), F.col(b).alias("b"), F.explode(F.expr(f"if({a} >= {b}, array(), sequence({a} div {PIECE}, ({b} - 1) div {PIECE}))")).alias("piece"))
    met = needed.join(_pieces(texts).hint("merge"), ["volume", "piece"])
    part = F.expr(f"substring(text, CAST(greatest(a - piece * {PIECE}, 0L) + 1 AS INT), CAST(least(b, (piece + 1) * {PIECE}) - greatest(a, piece * {PIECE}) AS INT))")
    whole = met.groupBy("volume", "id").agg(F.array_sort(F.collect_list(F.struct("piece", part.alias("part")))).alias("x"))
    whole = whole.select("volume", "id", F.array_join(F.transform("x", lambda x: x["part"]), "").alias(name))
    return wanted.join(whole.hint("merge"), ["volume", "id"], "left").withColumn(name, F.coalesce(name, F.lit("")))


def _replaced(one: str, other: str) -> Iterator[tuple[int, int, int]]:
    """Places in both and length of what is replaced by as many characters."""
    if len(one) == len(other):
        differs = np.flatnonzero(np.frombuffer(one.encode("utf-32-le"), np.uint32) != np.frombuffer(other.encode("utf-32-le"), np.uint32))
        # texts of one length that mostly agree are compared place by place
        if 4 * len(differs) <= len(one):
            first = np.flatnonzero(np.diff(differs, prepend=-2) != 1)
            for a, n in zip(differs[first].tolist(), np.diff(first, append=len(differs)).tolist(), strict=True):
                yield a, a, n
            return
    for tag, a, b, c, d in SequenceMatcher(None, one, other, autojunk=False).get_opcodes():
        if tag == "replace" and b - a == d - c:
            yield a, c, b - a


def substitutions(ocr_units: DataFrame, authority_units: DataFrame, member: str = HAN) -> DataFrame:
    """volume, unit, at, ocr, auth, find and replace: where a volume's text has one or two other characters than its authority.

    Both tables have volume, unit (their order, different in a volume) and text, of which characters of a class count.
    ``at`` is the first such place in the volume; find and replace have three characters about it. A change that
    a unit tells twice with the same characters about it is told once. Volumes without a common unique gram give
    nothing; null and empty texts hold no place; moved units count as left out and put in, and of
    units that passed each other those with more chosen anchors stay. Placed texts, the chain and
    what is to be compared are written once and read where they are needed.
    """
    ocr, authority = written(placed(ocr_units, member)), written(placed(authority_units, member))
    wanted = written(work(written(chained(runs(ocr, authority))), ocr, authority)).withColumn("id", F.xxhash64("a", "b", "c", "d", "own_a", "own_b"))
    both = _cut_out(_cut_out(wanted, ocr, "a", "b", "one"), authority, "c", "d", "other")

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for volume, a, own_a, own_b, one, other in zip(*[frame[c] for c in ("volume", "a", "own_a", "own_b", "one", "other")], strict=True):
                for x, y, n in _replaced(one, other):
                    if n <= LONGEST and own_a <= a + x < own_b:
                        before, after = one[max(0, x - ABOUT) : x], one[x + n : x + n + ABOUT]
                        rows.append((volume, a + x, one[x : x + n], other[y : y + n], before + one[x : x + n] + after, before + other[y : y + n] + after))
            yield pd.DataFrame(rows, columns=["volume", "at", "ocr", "auth", "find", "replace"])

    found = both.select("volume", "a", "own_a", "own_b", "one", "other").mapInPandas(f, f"volume {ocr.schema['volume'].dataType.simpleString()}, at long, ocr string, auth string, find string, replace string")
    # units and places in one order: the last unit before a place holds it
    starts = ocr.where("text <> ''").select("volume", "at", F.lit(0).alias("kind"), "unit")
    every = starts.unionByName(found.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy("volume").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = every.withColumn("unit", F.last("unit", ignorenulls=True).over(last)).where("kind = 1")
    return held.groupBy("volume", "unit", "ocr", "auth", "find", "replace").agg(F.min("at").alias("at")).select("volume", "unit", "at", "ocr", "auth", "find", "replace")
