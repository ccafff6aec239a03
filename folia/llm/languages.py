"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed character trigrams. A document's language proportions
are the mixture weights that expectation-maximisation finds for its trigram counts; the language
set is the one with the best likelihood less a penalty for each further language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import text_slices, with_fields

#: Bins of hashed trigrams; bounds the model and each document's counts.
BINS = 1 << 16
#: Labelled documents of each language that the model learns from, at most.
SAMPLE_PER_LANGUAGE = 5000
#: More languages than this are refused: the model (BINS x languages) is broadcast.
MAX_LANGUAGES = 1000
#: Log-likelihood that a further language must gain, times the log of the number of trigrams.
PENALTY = 3.0
CHUNK = 1 << 20
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: (BINS, languages) probabilities of a trigram given the language.
    table: np.ndarray


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def trigram_counts(text: bytes) -> np.ndarray | None:
    """Counts of hashed letter trigrams over BINS, or None where the text has no letter."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    counts, seen, last = np.zeros(BINS, np.int64), False, np.zeros(1, np.uint32)
    for at in range(0, max(len(points), 1), CHUNK):
        end = at + CHUNK >= len(points)
        c = np.concatenate([last, _letters()[points[at : at + CHUNK]], np.zeros(int(end), np.uint32)])
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        c = c[keep]
        seen = seen or bool(c.any())
        if len(c) > 2:
            h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(16), minlength=BINS)
        last = c[-2:]
    return counts if seen else None


def _em(n: np.ndarray, w: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Mixture weights for counts n and likelihoods w (bins x languages), and their log-likelihood."""
    share, total = start, n.sum()
    for _ in range(rounds):
        part = w * share
        new = (n / part.sum(1)) @ part / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(n @ np.log(w @ share))


def infer(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Proportions of the languages in a document, 0 for those outside its language set."""
    bins = np.flatnonzero(counts)
    n, w = counts[bins].astype(np.float64), table[bins]
    languages = table.shape[1]
    share, _ = _em(n, w, np.full(languages, 1 / languages), 12)
    order = np.argsort(-share, kind="stable")
    best, best_value = None, -np.inf
    for size in range(1, languages + 1):
        chosen = order[:size]
        if size > 1 and share[chosen[-1]] < 0.01:
            break
        own, value = _em(n, w[:, chosen], np.full(size, 1 / size), 25 if size > 1 else 1)
        value -= PENALTY * np.log(n.sum() + 1) * (size - 1)
        if value <= best_value:
            break
        best, best_value = np.zeros(languages), value
        best[chosen] = own
    return best


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learns from (doc_id, text, lang) rows with a language; at most about per_language rows of each.

    The rows taken are those whose hashed doc_id falls below per_language / rows of the language.
    """
    spark = labelled.sparkSession
    sizes = {r["lang"]: r["count"] for r in labelled.where("lang IS NOT NULL").groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((BINS, 0)))
    below = spark.createDataFrame([(k, per_language / v * 1e6) for k, v in sizes.items()], "lang string, below double")
    sample = labelled.join(F.broadcast(below), "lang").where(F.expr("pmod(xxhash64(doc_id), 1000000L) < below")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for piece, texts in text_slices(batches):
            for lang, text in zip(piece.column("lang").to_pylist(), texts, strict=True):
                if (c := trigram_counts(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + c
        for lang, c in sums.items():
            bins = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins)), pa.array(bins.astype(np.int32)), pa.array(c[bins])], ["lang", "bin", "n"])

    table = np.full((BINS, len(languages)), 0.1)
    rows = sample.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    table[rows["bin"], rows["lang"].map({k: i for i, k in enumerate(languages)})] += rows["n"]
    return Model(languages, table / table.sum(0))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score and languages (``en:0.93,fr:0.07``) to docs, from text alone.

    Null, empty and letterless texts, or a model without languages, give ``und`` and 0; ties go to
    the language first by code point. Rows pass through one by one, whatever else they hold.
    Columns of docs with those three names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "languages")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table = shared.value.languages, shared.value.table
        for piece, texts in text_slices(batches):
            found: list[tuple[str, float, str]] = []
            for text in texts:
                counts = trigram_counts(text) if text and languages else None
                if counts is None:
                    found.append((UNDETERMINED, 0.0, ""))
                    continue
                share = infer(counts, table)
                best = int(share.argmax())
                mixture = ",".join(f"{languages[i]}:{share[i]:.2f}" for i in np.argsort(-share, kind="stable") if share[i] > 0)
                found.append((languages[best], float(min(share[best], 1.0)), mixture))
            pred, score, mixture = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.string())], [*names, "lang_pred", "score", "languages"])

    return docs.mapInArrow(predict, with_fields(docs, "lang_pred string, score double, languages string"))


def held_out(docs: DataFrame) -> DataFrame:
    """Adds held_out: crc32 of doc_id as text leaves 0 modulo 5 (null doc_id: false, and not learned from)."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))


def training_rows(docs: DataFrame) -> DataFrame:
    return held_out(docs).where("NOT held_out AND doc_id IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")


def op2_language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages for every document."""
    model = fit(training_rows(docs))
    return held_out(identify(docs.select("doc_id", "text"), model)).select("doc_id", "held_out", "lang_pred", "score", "languages")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents in some learned language; a missing lang is filled with the predicted one."""
    model = fit(training_rows(docs))
    found = identify(docs, model).where(F.col("lang_pred") != UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)
