"""Brown class-based bigram model.

Exchange clustering assigns words to classes; a text's probability is the product of class transitions
and word emissions, both smoothed. The commonest words are clustered one by one on the driver. Then every
word of the lexicon is put into its best class, and moved again, in rounds on Spark: counts of a word's
neighbours by class come from all texts, and each word is scored against the class table. Words outside
the lexicon belong to one of a few kinds by length and last character, which are clustered like words.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm.common import free, most_frequent, stage, text_slices, words_of

#: Words clustered one by one, and their classes.
CLUSTERED, CLASSES = 1024, 64
#: Words that have a class of their own and whose counts every task holds; the counts of all others are joined.
LEXICON = 1 << 17
#: Rounds in which all other words of the lexicon move at once, and words scored together.
BATCHES, SCORED = 2, 256
#: Rounds of exchange at most.
ROUNDS = 8
#: Weight of the class's own probability in a transition's, and of an unseen word in its class.
TRANSITION, ADDED = 5.0, 0.5
#: The token after each text; no word, as it is white space.
END = b"\n"
KINDS = 16
#: Distinct words that a counting task holds before it passes its counts on.
COUNTED = 1 << 18


def kind_of(word: bytes) -> int:
    """0 to KINDS - 1 by last character (letter, stop, comma, other) and length."""
    last = word[-1:]
    end = 0 if last.isalpha() or last > b"\x7f" else 1 if last == b"." else 2 if last == b"," else 3
    return end * 4 + min(len(word) // 4, 3)


@dataclass(frozen=True)
class Model:
    #: The place of each word of the lexicon, its count in the training tokens, and its column, here its class.
    lexicon: dict[bytes, int]
    number: np.ndarray
    column: np.ndarray
    #: The class of each column; those from ``clustered`` on are the kinds'.
    classes: np.ndarray
    #: log10 of the probability of a class after a class, and of what an emission divides by.
    transition: np.ndarray
    emission: np.ndarray
    tokens: int
    words: int


def exchange(pairs: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each word that a word-by-word pass finds best for the mutual information of neighbours.

    pairs[v, w]: times that w follows v. Words move in order of frequency, ties to the first class.
    """
    n = len(pairs)
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable")
    own = np.empty(n, np.int64)
    own[order] = np.arange(n) % classes
    member = np.eye(classes)[own]
    joint = member.T @ pairs @ member
    log = lambda x: x * np.log(np.maximum(x, 1e-12))
    for _ in range(rounds):
        moved = 0
        for w in order:
            after = np.bincount(own, pairs[w], classes)
            before = np.bincount(own, pairs[:, w], classes)
            itself, c = pairs[w, w], own[w]
            after[c] -= itself
            before[c] -= itself
            joint[c] -= after
            joint[:, c] -= before
            joint[c, c] -= itself
            # totals of the classes keep what goes to and comes from w, whatever its class
            rows, columns = joint.sum(1) + before, joint.sum(0) + after
            gain = (log(joint + after) - log(joint)).sum(1) + (log(joint + before[:, None]) - log(joint)).sum(0)
            d = joint.diagonal()
            gain += log(d + after + before + itself) - log(d + after) - log(d + before) + log(d)
            gain -= log(rows + after.sum() + itself) - log(rows) + log(columns + before.sum() + itself) - log(columns)
            best = int(gain.argmax())
            if gain[best] <= gain[c] + 1e-9:
                best = int(c)
            joint[best] += after
            joint[:, best] += before
            joint[best, best] += itself
            own[w] = best
            moved += best != c
        if not moved:
            break
    return own


def best_classes(after: np.ndarray, before: np.ndarray, own: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The class of each word that is best for the mutual information of neighbours, all others staying.

    after[w, k], before[w, k]: times that class k follows and precedes w; joint[k, l]: that l follows k,
    with each word in its own class. Ties stay, then go to the first class.
    """
    w = np.arange(len(own))
    log = lambda x: x * np.log(np.maximum(x, 1e-12))
    without = np.repeat(joint[None], len(own), 0)
    without[w, own] -= after
    without[w, :, own] -= before
    # a word beside itself is taken off twice; what it is short of is nought
    without = np.maximum(without, 0)
    gain = np.zeros(after.shape)
    # only classes beside a word change what it adds
    for counts, table in ((after, without.transpose(0, 2, 1)), (before, without)):
        at, near = np.nonzero(counts)
        if len(at):
            held, starts = table[at, near], np.flatnonzero(np.diff(at, prepend=-1))
            gain[at[starts]] += np.add.reduceat(log(held + counts[at, near, None]) - log(held), starts)
    d = np.einsum("wkk->wk", without)
    gain += log(d + after + before) - log(d + after) - log(d + before) + log(d)
    rows, columns = without.sum(2) + before, without.sum(1) + after
    gain -= log(rows + after.sum(1)[:, None]) - log(rows) + log(columns + before.sum(1)[:, None]) - log(columns)
    best = gain.argmax(1)
    return np.where(gain[w, best] > gain[w, own] + 1e-9, best, own)


def _coded(train: DataFrame, places: dict[bytes, int]) -> DataFrame:
    """(codes): the tokens of several texts, an end before the first, as 32-bit places; len(places) and on are kinds."""
    shared = train.sparkSession.sparkContext.broadcast(places)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        each = np.arange(len(places))
        for _, texts in text_slices(batches):
            codes = _columns([END, *_tokens(texts)], places, each, len(places))[1]
            yield pa.RecordBatch.from_arrays([pa.array([codes.astype(np.int32).tobytes()], pa.binary())], ["codes"])

    return train.select("text").mapInArrow(f, "codes binary")


def _code_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for codes in batch.column("codes"):
            yield np.frombuffer(codes.as_buffer(), np.int32)


def _neighbours(coded: DataFrame, classes: np.ndarray, kinds: np.ndarray, number: int, first: int | None = None) -> DataFrame:
    """(place, slot, n): how often each class follows (slots from 0) and precedes (slots from ``number``) the words
    from place ``first`` on, if any move, and from place len(classes) on the table of classes after classes.

    A task holds one count for each word and slot and passes on those that are not nought.
    """
    words, width = len(classes), 2 * number
    end = words * width
    shared = coded.sparkSession.sparkContext.broadcast(np.concatenate([classes, kinds]))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = end if first is not None else 0
        total = np.zeros(shift + number * number, np.int64 if first is None else np.int32)
        for place in _code_runs(batches):
            own = shared.value[place]
            keys = [shift + own[:-1] * number + own[1:]]
            if first is not None:
                moves, at = (place >= first) & (place < words), place.astype(np.int64) * width
                keys.append((at[:-1] + own[1:])[moves[:-1]])
                keys.append((at[1:] + number + own[:-1])[moves[1:]])
            found, n = np.unique(np.concatenate(keys), return_counts=True)
            total[found] += n.astype(total.dtype)
        filled = np.flatnonzero(total)
        for at in range(0, len(filled), 1 << 16):
            found = filled[at : at + (1 << 16)]
            slots = found + (end - shift)
            yield pa.RecordBatch.from_arrays([pa.array((slots // width).astype(np.int32)), pa.array((slots % width).astype(np.int32)), pa.array(total[found].astype(np.int64))], ["place", "slot", "n"])

    return coded.mapInArrow(f, "place int, slot int, n long").groupBy("place", "slot").agg(F.sum("n").alias("n"))


def _class_table(neighbours: DataFrame, words: int, number: int) -> np.ndarray:
    """Times that a class follows a class, from the rows of _neighbours()."""
    joint = np.zeros(number * number)
    rows = neighbours.where(F.col("place") >= words).toPandas()
    joint[(rows["place"] - words) * 2 * number + rows["slot"]] = rows["n"]
    return joint.reshape(number, number)


def _moved(neighbours: DataFrame, classes: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The classes of the lexicon's words after each has moved to its best; blocks of words are scored in tasks."""
    number, words = len(joint), len(classes)
    shared = neighbours.sparkSession.sparkContext.broadcast((classes, joint))

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        classes, joint = shared.value
        place, row = np.unique(rows["place"].to_numpy(), return_inverse=True)
        counts = np.zeros((len(place), 2 * number))
        counts[row, rows["slot"].to_numpy()] = rows["n"].to_numpy()
        best = best_classes(counts[:, :number], counts[:, number:], classes[place], joint)
        return pd.DataFrame({"place": place, "best": best})

    blocks = neighbours.where(F.col("place") < words).groupBy(F.expr(f"place div {SCORED}"))
    found = blocks.applyInPandas(f, "place int, best int").toPandas()
    out = classes.copy()
    out[found["place"]] = found["best"]
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n) of all texts' tokens, ends included; partial counts leave tasks before the shuffle."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        counts: Counter[bytes] = Counter()
        for _, texts in text_slices(batches):
            for text in texts:
                counts.update(words_of(text))
            counts[END] += len(texts)
            if len(counts) > COUNTED:
                yield rows()
        counts += Counter()
        yield rows()

    return docs.select("text").mapInArrow(f, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _kind_column() -> Column:
    """kind_of() in SQL."""
    last = "substring(word, length(word), 1)"
    return F.expr(f"""
        CASE WHEN {last} > X'7F' OR {last} BETWEEN X'41' AND X'5A' OR {last} BETWEEN X'61' AND X'7A' THEN 0
             WHEN {last} = X'2E' THEN 1 WHEN {last} = X'2C' THEN 2 ELSE 3 END * 4 + least(length(word) div 4, 3)""")


def fit(train: DataFrame, counts: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES, lexicon: int = LEXICON) -> Model:
    """Learns from the texts of train, all of them, and their word counts.

    What comes to the driver is bounded by the parameters: ``lexicon`` words and their classes, one count
    for each pair of the clustered words and kinds, and totals.
    """
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    top = [(bytes(r["word"]), r["n"]) for r in most_frequent(counts, lexicon).collect()]
    top.sort(key=lambda r: (-r[1], r[0]))
    places = {w: i for i, (w, _) in enumerate(top)}
    column = np.array([i if i < clustered else clustered + kind_of(w) for i, (w, _) in enumerate(top)], np.int64)
    size = clustered + KINDS
    coded = stage(_coded(train, places), "classlm-codes")
    shared = train.sparkSession.sparkContext.broadcast(np.concatenate([column, np.arange(clustered, size)]))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for codes in _code_runs(batches):
            at = shared.value[codes]
            total += np.bincount(at[:-1] * size + at[1:], minlength=size * size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["pair", "n"])

    pairs = np.zeros(size * size)
    rows = coded.mapInArrow(f, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs[rows["pair"]] = rows["n"]
    pairs = pairs.reshape(size, size)
    own = exchange(pairs, classes)

    # the lexicon's other words begin in the classes of their kinds
    kinds, named = own[clustered:], own[column]
    for _ in range(BATCHES if len(top) > clustered else 0):
        neighbours = stage(_neighbours(coded, named, kinds, classes, clustered), "classlm-neighbours")
        named = _moved(neighbours, named, _class_table(neighbours, len(top), classes))
        free(neighbours)
    joint = _class_table(_neighbours(coded, named, kinds, classes), len(top), classes)
    free(coded)
    share = (joint.sum(0) + 1) / (joint.sum() + classes)
    transition = np.log10((joint + TRANSITION * share) / (joint.sum(1, keepdims=True) + TRANSITION))
    # of the kinds' counts those of the lexicon's words go to their own classes
    number, distinct = np.zeros(KINDS), np.zeros(KINDS)
    for r in counts.groupBy(_kind_column().alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        number[r["kind"]], distinct[r["kind"]] = r["n"], r["words"]
    held, kind = np.array([n for _, n in top], np.int64), np.array([kind_of(w) for w, _ in top], np.int64)
    number -= np.bincount(kind, held, KINDS)
    distinct -= np.bincount(kind, minlength=KINDS)
    number = np.bincount(named, held, classes) + np.bincount(kinds, number, classes)
    distinct = np.bincount(named, minlength=classes) + np.bincount(kinds, distinct, classes)
    emission = np.log10(number + ADDED * (distinct + 1))
    columns = np.zeros(size, np.int64)
    columns[:classes], columns[clustered:] = np.arange(classes), kinds
    return Model(places, held, named, columns, transition, emission, totals["tokens"], totals["words"])


def _tokens(texts: list[bytes]) -> list[bytes]:
    """The tokens of all texts, each with its end, so that every text's first token follows an end."""
    out: list[bytes] = []
    for text in texts:
        out += words_of(text)
        out.append(END)
    return out


def _columns(words: list[bytes], places: dict[bytes, int], column: np.ndarray, clustered: int) -> tuple[np.ndarray, np.ndarray]:
    """The place (-1 outside the lexicon) and column of each word."""
    place = np.array([places.get(w, -1) for w in words], np.int64)
    out = column[place] if len(column) else np.zeros(len(words), np.int64)
    for i in np.flatnonzero(place < 0).tolist():
        out[i] = clustered + kind_of(words[i])
    return place, out


def score(docs: DataFrame, model: Model, counts: DataFrame, clustered: int = CLUSTERED) -> DataFrame:
    """One row per row of docs (doc_id, text, further columns are dropped): doc_id, n_tokens, n_known,
    base_score and score.

    Null and empty texts are their end token alone. Tokens with counts in the lexicon are summed where the
    text is read; the others' counts are joined by word, each once per text, and summed by text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["row", "doc_id", "n_tokens", "n_known", "logs", "classes", "rare", "times"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        logs = np.append(np.log10(m.number + ADDED), 0.0)
        for piece, texts in text_slices(batches):
            words = _tokens(texts)
            place, column = _columns([END, *words], m.lexicon, m.column, clustered)
            own, place = m.classes[column], place[1:]
            # the end of one text stands before the next one's first token
            classes = m.transition[own[:-1], own[1:]] - m.emission[own[1:]]
            ends = np.flatnonzero(np.array([w == END for w in words])) + 1
            starts = np.concatenate([[0], ends[:-1]])
            sums = [np.add.reduceat(x, starts) for x in ((place >= 0).astype(np.int64), logs[place], classes)] if texts else [[], [], []]
            rows = []
            for doc_id, a, b, known, held, total in zip(piece.column("doc_id").to_pylist(), starts.tolist(), ends.tolist(), *sums, strict=True):
                rare = Counter([words[i] for i in (np.flatnonzero(place[a:b] < 0) + a).tolist()])
                rows.append((random.getrandbits(63), doc_id, b - a, int(known), float(held), float(total), list(rare), list(rare.values())))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    schema = "row long, doc_id long, n_tokens long, n_known long, logs double, classes double, rare array<binary>, times array<int>"
    held = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(f, schema), "classlm-texts")
    rare = held.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    found = rare.join(counts.withColumnRenamed("n", "count"), "word", "left").groupBy("row").agg(
        F.sum(F.expr(f"times * log10(coalesce(count, 0) + {ADDED}D)")).alias("rare_logs"), F.sum(F.expr("if(count > 0, times, 0)")).alias("rare_known")
    )
    logs = F.expr("logs + coalesce(rare_logs, 0D)")
    base = logs - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + ADDED * (model.words + 1))))
    return held.drop("rare", "times").join(found, "row", "left").select(
        "doc_id", "n_tokens", F.expr("n_known + coalesce(rare_known, 0)").alias("n_known"), base.alias("base_score"), (logs + F.col("classes")).alias("score")
    )


def op6_class_lm(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Rows without doc_id are scored but neither held out nor learned from.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    train = docs.where(remainder != 1).select("text")
    counts = stage(count_words(train), "classlm-counts")
    model = fit(train, counts)
    scored = score(docs, model, counts)
    held_out = F.coalesce(remainder == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
