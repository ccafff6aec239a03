"""Byte-level BPE with a minimal acyclic transducer as lexicon.

Words that are frequent in the corpus are compiled, with their token ids as outputs, into an automaton
that shares prefixes and suffixes; tasks memory-map its arrays. Words outside it are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import most_frequent, stage, text_slices, with_fields

#: Words in the lexicon at most, and their least count in the corpus.
LEXICON_WORDS, LEXICON_COUNT = 1 << 15, 4
#: Words longer than this many bytes are never compiled.
LEXICON_BYTES = 32
#: Distinct words that a task remembers beside the lexicon; more start it anew.
MEMO_WORDS = 1 << 20
#: Ids of a text that are written as digits or bytes at a time.
CHUNK = 1 << 18
#: Bits of a token id in a merge's number, and a number above all merges.
ID_BITS, NEVER = 24, 1 << 62
#: Distinct words that a counting task holds before it passes its counts on.
COUNTED_WORDS = 1 << 18

# What Unicode 16, which the tokenizers library knows, adds to the letters and numbers of Unicode 15.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# Unicode white space.
SPACES = ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
# Fixed values of the byte-level pre-tokeniser that the tokenizer file names; {L}, {N} and {S} are classes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"


def _class(category: str, new: tuple[tuple[int, int], ...]) -> str:
    """The members of a regex class: a general category and further ranges."""
    held = bytearray(0x110000)
    for i in range(0x110000):
        held[i] = unicodedata.category(chr(i))[0] == category
    for first, last in new:
        held[first : last + 1] = b"\1" * (last + 1 - first)
    return _members([(m.start(), m.end() - 1) for m in re.finditer(b"\1+", held)])


def _members(ranges: Iterable[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(1)
def word_pattern() -> re.Pattern[str]:
    """The pre-tokeniser's pattern with the library's classes, whatever Unicode version a regex module has."""
    classes = {"{L}": _class("L", NEW_LETTERS), "{N}": _class("N", NEW_NUMBERS), "{S}": _members(SPACES)}
    pattern = PATTERN
    for name, members in classes.items():
        pattern = pattern.replace(name, members)
    return re.compile(pattern)


#: Texts in which a piece may span a space that splits them: white space on both sides, or a run at the end.
_IRREGULAR = re.compile(rf"  |[{_members(SPACES)}] [{_members(SPACES)}]| \Z")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, and its byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, source: str) -> None:
        held = json.loads(source)
        before, model = held.get("pre_tokenizer") or {}, held["model"]
        plain = not held.get("normalizer") and not any(t.get(flag) for t in held["added_tokens"] for flag in ("lstrip", "rstrip", "single_word"))
        level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        whole = model.get("type", "BPE") == "BPE" and not any(model.get(x) for x in ("ignore_merges", "dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        if not (plain and level and whole):
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_letters()
        spelled = {token: bytes(letters[c] for c in token) for token in held["model"]["vocab"]}
        self.bytes_of = {i: spelled[token] for token, i in held["model"]["vocab"].items()}
        ids = {b: i for i, b in self.bytes_of.items()}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        #: rank and new id of each pair of ids, in one number; lower ranks are lower numbers
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (spelled[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merges.setdefault(ids[left] << ID_BITS | ids[right], rank << ID_BITS | ids[left + right])
        self.pairs = np.array(sorted(self.merges) or [-1], np.int64)
        self.ranked = np.array([self.merges.get(k, NEVER) for k in self.pairs.tolist()], np.int64)
        self.single_array = np.array(self.single, np.int64)
        most = max(self.bytes_of, default=0) + 1
        #: of each id: its digits and a comma, filled up with zeros; where its bytes lie among all ids' bytes
        self.digit_table = np.array([f"{i}," for i in range(most)], f"S{len(str(most)) + 1}").view(np.uint8).reshape(most, -1)
        held_bytes = [self.bytes_of.get(i, b"") for i in range(most)]
        self.flat, self.sizes = np.frombuffer(b"".join(held_bytes), np.uint8), np.array([len(b) for b in held_bytes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = word_pattern()
        #: ids of recent pieces, as bytes of 32-bit numbers
        self.recent: dict[str, bytes] = {}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: always the pair of least rank, the leftmost first.

        The ranks of all pairs are kept and only those about a merge are looked up anew. Long words keep
        their candidate pairs in a heap over linked positions, so that the work grows with n log n.
        """
        ids = [self.single[b] for b in word]
        if len(ids) > 256:
            return self._merge_long(ids)
        find = self.merges.get
        ranks = [find(a << ID_BITS | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < NEVER:
            i, new = ranks.index(best), best & (1 << ID_BITS) - 1
            ids[i : i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = find(ids[i - 1] << ID_BITS | new, NEVER)
            if i < len(ranks):
                ranks[i] = find(new << ID_BITS | ids[i + 1], NEVER)
        return ids

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """merge() of many words, as bytes of 32-bit numbers: those of up to ``LEXICON_BYTES`` bytes take their merges together, one each in a round."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        rows = np.flatnonzero((sizes > 0) & (sizes <= LEXICON_BYTES))
        for i in np.flatnonzero(sizes > LEXICON_BYTES).tolist():
            out[i] = np.array(self.merge(words[i]), np.int32).tobytes()
        # words of like length at a time, so that rows aren't mostly padding
        for few in np.array_split(rows[np.argsort(sizes[rows], kind="stable")], max(1, len(rows) // 4096)):
            if not len(few):
                continue
            left, width = sizes[few], int(sizes[few].max())
            ids = np.full((len(few), width + 1), -1, np.int64)
            ids[:, :width][np.arange(width) < left[:, None]] = self.single_array[np.frombuffer(b"".join([words[i] for i in few.tolist()]), np.uint8)]
            ranks = self._ranks(ids[:, :-1], ids[:, 1:])
            live, columns = np.arange(len(few)), np.arange(width + 1)
            while len(live):
                at = ranks[live].argmin(1)
                best = ranks[live, at]
                going = best < NEVER
                live, at, best = live[going], at[going], best[going]
                if not len(live):
                    break
                # the pair becomes one id and what follows moves up
                held = ids[live]
                moved = np.column_stack([held[:, 1:], np.full(len(live), -1)])
                after = columns > at[:, None]
                held = np.where(after, moved, held)
                held[np.arange(len(live)), at] = best & (1 << ID_BITS) - 1
                ids[live] = held
                known = ranks[live]
                known = np.where(after[:, 1:], np.column_stack([known[:, 1:], np.full(len(live), NEVER)]), known)
                row = np.arange(len(live))
                known[row, at] = self._ranks(held[row, at], held[row, at + 1])
                before = np.maximum(at - 1, 0)
                known[row, before] = self._ranks(held[row, before], held[row, before + 1])
                ranks[live] = known
                left[live] -= 1
            packed, step = ids.astype(np.int32).tobytes(), 4 * ids.shape[1]
            for k, (i, n) in enumerate(zip(few.tolist(), left.tolist(), strict=True)):
                out[i] = packed[k * step : k * step + 4 * n]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << ID_BITS | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((self.pairs[at] == keys) & (right >= 0), self.ranked[at], NEVER)

    def ids_of_many(self, words: list[str]) -> list[bytes]:
        """Ids of many stretches of text without special tokens; what pieces are not remembered is merged together."""
        pieces = list(map(self.words.findall, words))
        new = list(set().union(*pieces) - self.recent.keys())
        if len(self.recent) + len(new) > MEMO_WORDS:
            self.recent.clear()
            new = list(set().union(*pieces))
        self.recent.update(zip(new, self.merge_many([p.encode() for p in new]), strict=True))
        ids_of = self.recent.__getitem__
        return [b"".join(map(ids_of, p)) for p in pieces]

    def digits(self, ids: np.ndarray) -> bytes:
        """The ids as digits, a comma after each."""
        out = self.digit_table[ids].ravel()
        return out[out != 0].tobytes()

    def spelled(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        shift = self.starts[ids] - (np.cumsum(sizes) - sizes)
        return self.flat[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)].tobytes()

    def _merge_long(self, ids: list[int]) -> list[int]:
        from heapq import heapify, heappop, heappush

        n = len(ids)
        after, before, live = [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
        find = self.merges.get
        heap = [(f, i, ids[i], ids[i + 1]) for i in range(n - 1) if (f := find(ids[i] << ID_BITS | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            best, i, left, right = heappop(heap)
            j = after[i]
            if not live[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], live[j], after[i] = best & (1 << ID_BITS) - 1, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (f := find(ids[x] << ID_BITS | ids[y])) is not None:
                    heappush(heap, (f, x, ids[x], ids[y]))
        return [ids[i] for i in range(n) if live[i]]


class Transducer:
    """Minimal acyclic transducer from words to id lists, as flat arrays in one mapped file.

    State s has the arcs first[s]:first[s + 1], sorted by byte; an arc has a byte, a target and an
    output, the number of smaller words that it passes by. The sum of a path's outputs is the word's
    index, and ids of the words lie one after another. States with equal continuations are one state.
    """

    def __init__(self, buffer: mmap.mmap | bytes) -> None:
        sizes = np.frombuffer(buffer, np.int64, 4)
        at, parts = 32, []
        for kind, n in ((np.int32, sizes[0] + 1), (np.int32, sizes[1]), (np.int32, sizes[1]), (np.int32, sizes[2] + 1), (np.int32, sizes[3]), (np.uint8, sizes[0]), (np.uint8, sizes[1])):
            parts.append(np.frombuffer(buffer, kind, int(n), at))
            at += parts[-1].nbytes
        self.first, self.target, self.passed, self.ids_at, self.ids, self.final, self.label = parts
        # one number for state and byte, sorted: arcs are found by bisection for many words at once
        self.keys = np.repeat(np.arange(int(sizes[0]), dtype=np.int64), np.diff(self.first)) << 8 | self.label

    @staticmethod
    def compile(entries: dict[bytes, list[int]]) -> bytes:
        """Builds the automaton from sorted words, keeping one state for each set of continuations."""
        words = sorted(entries)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[tuple[list[tuple[int, int]], bool, int]] = [([], False, -1)]

        def close(down_to: int) -> None:
            while len(path) - 1 > down_to:
                arcs, final, byte = path.pop()
                key = (final, tuple(arcs))
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                path[-1][0].append((byte, register[key]))

        last = b""
        for word in words:
            common = next((i for i, (x, y) in enumerate(zip(last, word, strict=False)) if x != y), min(len(last), len(word)))
            close(common)
            for byte in word[common:]:
                path.append(([], False, byte))
            path[-1] = (path[-1][0], True, path[-1][2])
            last = word
        close(0)
        states.append((path[0][1], tuple(path[0][0])))
        below: list[int] = []
        for final, arcs in states:  # targets come first
            below.append(final + sum(below[t] for _, t in arcs))
        first, label, target, passed = [0], [], [], []
        for final, arcs in states:
            sum_before = int(final)
            for byte, t in arcs:
                label.append(byte)
                target.append(t)
                passed.append(sum_before)
                sum_before += below[t]
            first.append(len(label))
        ids_at = np.concatenate([[0], np.cumsum([len(entries[w]) for w in words], dtype=np.int64)])
        ids = [i for w in words for i in entries[w]]
        parts = [np.array(x, np.int32) for x in (first, target, passed, ids_at, ids)] + [np.array([s[0] for s in states], np.uint8), np.array(label, np.uint8)]
        return np.array([len(states), len(label), len(words), len(ids)], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The index of each word, -1 for those outside; all words advance a byte at a time together."""
        found = np.full(len(words), -1, np.int64)
        if not words or not len(self.keys):
            return found
        sizes = np.array([len(w) for w in words])
        rows = np.flatnonzero(sizes <= LEXICON_BYTES)
        text = np.zeros((len(rows), LEXICON_BYTES), np.uint8)
        flat = np.frombuffer(b"".join(words[i] for i in rows), np.uint8)
        text[np.arange(LEXICON_BYTES) < sizes[rows][:, None]] = flat
        state, index = np.full(len(rows), len(self.final) - 1, np.int64), np.zeros(len(rows), np.int64)
        alive = np.arange(len(rows))
        for i in range(LEXICON_BYTES + 1):
            ends = sizes[rows[alive]] == i
            done = alive[ends & (self.final[state[alive]] == 1)]
            found[rows[done]] = index[done]
            alive = alive[~ends]
            if not len(alive) or i == LEXICON_BYTES:
                break
            keys = state[alive] << 8 | text[alive, i]
            arc = np.searchsorted(self.keys, keys)
            ok = (arc < len(self.keys)) & (self.keys[np.minimum(arc, len(self.keys) - 1)] == keys)
            alive, arc = alive[ok], arc[ok]
            index[alive] += self.passed[arc]
            state[alive] = self.target[arc]
        return found

    def ids_of(self, index: int) -> bytes:
        """Ids of a word, as bytes of 32-bit numbers."""
        return self.ids[self.ids_at[index] : self.ids_at[index + 1]].tobytes()


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS, least: int = LEXICON_COUNT) -> list[bytes]:
    """The most frequent space-separated words of all texts, with what else stands at them and a space before.

    Counts cover every document; only the most frequent ``most`` words come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if len(w) < LEXICON_BYTES and w.isalpha()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        counts: Counter[str] = Counter()
        for _, texts in text_slices(batches):
            for text in texts:
                counts.update(text.decode().split(" "))
            if len(counts) > COUNTED_WORDS:
                yield rows()
        yield rows()

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = most_frequent(stage(counted.where(f"n >= {least}"), "bpe-words"), most)
    return [b" " + r["word"].encode() for r in top.select("word").collect()]


def compiled(spark: SparkSession, vocabulary: Vocabulary, words: list[bytes]) -> str:
    """Compiles the lexicon and gives its file to every executor; returns the file's name."""
    short = [w for w in words if len(w) <= LEXICON_BYTES]
    ids = vocabulary.ids_of_many([w.decode() for w in short])
    content = Transducer.compile({w: np.frombuffer(x, np.int32).tolist() for w, x in zip(short, ids, strict=True)})
    name = f"lexicon-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(), name)
    with open(path, "wb") as file:
        file.write(content)
    spark.sparkContext.addFile(path)
    return name


@lru_cache(2)
def _mapped(name: str) -> Transducer:
    with open(SparkFiles.get(name), "rb") as file:
        return Transducer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))


@lru_cache(2)
def _vocabulary(name: str) -> Vocabulary:
    with open(SparkFiles.get(name), encoding="utf-8") as file:
        return Vocabulary(file.read())


class Encoder:
    """Encodes and decodes whole texts by space-separated words; each is looked up in a memo, the lexicon, then merged.

    A single space between other characters always begins a piece, so a word with the space before it has the
    same ids wherever it stands. Texts with runs of white space about spaces, or with special tokens, are cut
    by the pattern as a whole.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        #: ids of words, as bytes of 32-bit numbers: of those with a space before, which is left out, and of others
        self.spaced: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}

    def words(self, text: str) -> tuple[list[str], list[str]]:
        """(pieces, words): pieces that begin the text, special tokens alone, and words that each have a space before."""
        special = self.vocabulary.special
        if self.vocabulary.cut is not None and any(s in text for s in special):
            return [w for part in self.vocabulary.cut.split(text) for w in ([part] if part in special else self.vocabulary.words.findall(part))], []
        if _IRREGULAR.search(text):
            return self.vocabulary.words.findall(text), []
        rest = text.split(" ")
        return [rest[0]] if rest[0] else [], rest[1:]

    def learn(self, words: set[str], memo: dict[str, bytes], before: str) -> None:
        """Puts the ids of words, with what stands before each, in the memo; the lexicon is asked for all at once."""
        special, new = self.vocabulary.special, list(words)
        found = self.lexicon.find([(before + w).encode() for w in new]) if self.lexicon else np.full(len(new), -1)
        for i in np.flatnonzero(found >= 0).tolist():
            memo[new[i]] = self.lexicon.ids_of(found[i])
        unknown = [new[i] for i in np.flatnonzero(found < 0).tolist()]
        if not before:
            memo.update({w: np.int32(special[w]).tobytes() for w in unknown if w in special})
            unknown = [w for w in unknown if w not in special]
        memo.update(zip(unknown, self.vocabulary.ids_of_many([before + w for w in unknown]), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.words(t) for t in texts]
        found = []
        for k, (memo, before) in enumerate(((self.other, ""), (self.spaced, " "))):
            held = [list(map(memo.get, w[k])) for w in cut]
            gaps = [[i for i, x in enumerate(ids) if x is None] if None in ids else [] for ids in held]
            new = {w[k][i] for w, at in zip(cut, gaps, strict=True) for i in at}
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
            self.learn(new, memo, before)
            for w, ids, at in zip(cut, held, gaps, strict=True):
                for i in at:
                    ids[i] = memo[w[k][i]]
            found.append(held)
        return [np.frombuffer(b"".join([*a, *b]), np.int32) for a, b in zip(*found, strict=True)]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text the number of its ids, and the digests of them and of what they decode to."""
        out = []
        for ids in self.encode(texts):
            digest, spelled = hashlib.sha256(), []
            for at in range(0, len(ids), CHUNK):
                part = ids[at : at + CHUNK]
                digits = self.vocabulary.digits(part)
                digest.update(digits if at + CHUNK < len(ids) else digits[:-1])
                spelled.append(self.vocabulary.spelled(part))
            decoded = b"".join(spelled).decode("utf-8", "replace").encode()
            out.append((len(ids), digest.hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return out

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text; bytes that are no UTF-8 become replacement characters."""
        return self.vocabulary.spelled(np.array(ids, np.int64)).decode("utf-8", "replace").encode()


def encode(docs: DataFrame, tokenizer: str, digests: bool = False, words: list[bytes] | None = None) -> DataFrame:
    """Adds to docs (any columns, text among them) either ids array<int>, or n_tokens, ids_sha256 and
    decoded_sha256, the digests of ids and of the text decoded from them.

    Texts are encoded whole; null counts as empty and gives no ids. tokenizer is the path of a byte-level
    BPE file on the driver. words: the lexicon's words, else the frequent ones of docs. Results don't
    depend on the lexicon. Repeated rows are encoded alike; an empty table gives no rows.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids"]
    docs = docs.drop(*names)
    spark, columns = docs.sparkSession, docs.columns
    with open(tokenizer, encoding="utf-8") as file:
        source = file.read()
    folder = tempfile.mkdtemp()
    vocabulary_name = f"vocabulary-{uuid.uuid4().hex}.json"
    with open(os.path.join(folder, vocabulary_name), "w", encoding="utf-8") as file:
        file.write(source)
    spark.sparkContext.addFile(os.path.join(folder, vocabulary_name))
    lexicon_name = compiled(spark, Vocabulary(source), frequent_words(docs) if words is None else words)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_vocabulary(vocabulary_name), _mapped(lexicon_name))
        for piece, texts in text_slices(batches):
            if not digests:
                ids = encoder.encode([t.decode() for t in texts])
                offsets = np.cumsum([0, *(len(x) for x in ids)]).astype(np.int32)
                new = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))]
            else:
                rows = encoder.digests([t.decode() for t in texts])
                new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*piece.columns, *new], [*columns, *names])

    return docs.mapInArrow(f, with_fields(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds text, decoded from ids array<int> (null ids: null), in place of any column of that name."""
    encoded = encoded.drop("text")
    columns = encoded.columns
    with open(tokenizer, encoding="utf-8") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(shared.value), None)
        for batch in batches:
            texts = [None if ids is None else encoder.decode(ids).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*columns, "text"])

    return encoded.mapInArrow(f, with_fields(encoded, "text string"))


def op1_bpe(docs: DataFrame, tokenizer: str) -> DataFrame:
    return encode(docs.select("doc_id", "text"), tokenizer, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
