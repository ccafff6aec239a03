"""The numbered operators against brute force, on small tables with nulls, ties, copies and odd texts."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from folia.llm import bpe, capfilters, classlm, common, fingerprints, jaccard, languages, mixing, privacy, toolcalls, urls
from folia.llm.common import connected_components, most_frequent

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "123 456", "a", "no-letters: 1", "x" * 5000, "\x1c\x85\xa0 é 😀 <|endoftext|> end"]


def documents(spark, n=60, seed=1):
    rng = random.Random(seed)
    words = {"en": "the of and to in that with from".split(), "de": "der die und ist nicht über für mit".split(), "fr": "le la des était où ça une avec".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.choice([1, 3, 12, 60]))), lang, f"src{rng.randrange(4)}", 0))
    rows += [(n + i, t, None if i % 2 else "en", None, 0) for i, t in enumerate(ODD)]
    rows += [(900, rows[5][1], "en", "src0", 0), (901, rows[5][1], "en", "src1", 0), (901, rows[5][1], "en", "src1", 0)]
    return spark.createDataFrame(rows, DOCS), rows


@pytest.fixture(scope="module")
def docs(spark):
    df, rows = documents(spark)
    return df.cache(), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- 1 -------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    df, rows = docs
    library = Tokenizer.from_file(TOKENIZER)
    got = {}
    for r in bpe.op1_bpe(df, TOKENIZER).collect():
        got.setdefault(r.doc_id, r)
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_splits_equal_the_library_for_every_character():
    from tokenizers import pre_tokenizers

    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    rng = random.Random(3)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rng.shuffle(points)
    own = bpe.word_pattern()
    for at in range(0, len(points), 40):
        text = "".join(chr(i) + rng.choice(["", "", " ", "a", "1", "!", "'s", "\n"]) for i in points[at : at + 40])
        assert [b for _, (_, b) in library.pre_tokenize_str(text)] == [m.end() for m in own.finditer(text)], ascii(text)


def test_words_by_spaces_are_encoded_like_whole_texts():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    with open(TOKENIZER, encoding="utf-8") as file:
        encoder = bpe.Encoder(bpe.Vocabulary(file.read()), bpe.Transducer(bpe.Transducer.compile({b" the": [262], b" a": [257]})))
    rng = random.Random(4)
    parts = [" ", " ", "  ", "\n", "\t", "\u3000", "\xa0", "\x1c", "the", "a", "it's", "12", "!?", "é", "<|endoftext|>", "word,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([1, 3, 8, 20]))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_other_tokenizer_files_are_refused():
    with open(TOKENIZER, encoding="utf-8") as file:
        held = json.load(file)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}):
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(held | change))


def test_bpe_round_trip_keeps_other_columns(docs):
    df, rows = docs
    clash = df.withColumn("ids", F.lit("clash")).select("doc_id", "text", "ids", F.col("lang").alias("n_tokens"))
    back = bpe.decode(bpe.encode(clash, TOKENIZER), TOKENIZER)
    assert back.columns == ["doc_id", "n_tokens", "ids", "text"]
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i, t or "") for i, t, *_ in rows)


def test_transducer_is_minimal_and_exact():
    words = [b"", b" at", b" bat", b" cat", b"at", b"bat"]
    lexicon = bpe.Transducer(bpe.Transducer.compile({w: [i, i * 2] for i, w in enumerate(words)}))
    assert [np.frombuffer(lexicon.ids_of(i), np.int32).tolist() for i in lexicon.find(words)] == [[i, i * 2] for i in range(len(words))]
    assert lexicon.find([b"a", b" ", b"cat", b"batt", b"z" * 40]).tolist() == [-1] * 5
    # all words end alike, so states are shared
    assert len(lexicon.final) == 5


def test_long_words_merge_like_short_ones():
    with open(TOKENIZER, encoding="utf-8") as file:
        vocabulary = bpe.Vocabulary(file.read())
    rng = random.Random(2)
    for n in (1, 2, 30, 49, 256, 257, 600):
        word = bytes(rng.choice(b"abtheing \xc3\xa9") for _ in range(n))
        ids = [vocabulary.single[b] for b in word]
        while True:
            pairs = [a << bpe.ID_BITS | b for a, b in zip(ids, ids[1:], strict=False)]
            ranked = [(vocabulary.merges[p], i) for i, p in enumerate(pairs) if p in vocabulary.merges]
            if not ranked:
                break
            best, i = min(ranked)
            ids[i : i + 2] = [best & (1 << bpe.ID_BITS) - 1]
        assert vocabulary.merge(word) == ids
    words = [bytes(rng.choice(b"abtheing \xc3\xa9") for _ in range(rng.randrange(1, 40))) for _ in range(9000)]
    assert [np.frombuffer(x, np.int32).tolist() for x in vocabulary.merge_many([*words, b""])] == [*map(vocabulary.merge, words), []]


# -- 2 -------------------------------------------------------------------------------------------------


def test_languages_are_told_apart(docs):
    df, rows = docs
    got = languages.op2_language_id(df).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, *_ in rows}
    lang = {i: x for i, _, x, *_ in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))
    long = [r for r in got if r.doc_id < 60 and len(text[r.doc_id]) > 40]
    assert sum(r.lang_pred == lang[r.doc_id] for r in long) >= 0.95 * len(long)


def test_mixtures_have_their_languages():
    rng = np.random.default_rng(0)
    table = rng.dirichlet(np.ones(languages.BINS) * 0.01, 3).T + 1e-9
    table /= table.sum(0)
    counts = rng.multinomial(3000, table[:, 0] / table[:, 0].sum()) + rng.multinomial(1000, table[:, 2] / table[:, 2].sum())
    share = languages.infer(counts, table)
    assert np.allclose(share, [0.75, 0, 0.25], atol=0.05)


def test_no_training_rows_give_und(docs):
    df, _ = docs
    assert {r.lang_pred for r in languages.op2_language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# -- 3 -------------------------------------------------------------------------------------------------


def vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(6):
        base = rng.standard_normal(24)
        rows += [(base + rng.standard_normal(24) * s, i % 2) for s in (0, 0, 0.05, 0.1, 0.15, 0.3)]
    table = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    table += [(100, None, 0), (101, [0.0] * 24, 0), (102, [float("nan")] + [1.0] * 23, 0), (103, table[0][1], None), (104, [None] + [1.0] * 23, 0), (105, [float("inf")] + [1.0] * 23, 0)]
    table += [(106, [2 * x for x in table[0][1]], 0), (107, [1.0, 2.0], 0), (108, [2.0, 4.0], 0)]
    return spark.createDataFrame(table, "vec_id long, embedding array<double>, label int"), table


def test_near_vectors_equal_brute_force(spark):
    df, table = vectors(spark)
    got = {r.vec_id: r for r in capfilters.near_duplicates(df).collect()}
    fine = [(i, np.array(v, float), label) for i, v, label in table if label is not None and v is not None and None not in v]
    fine = [x for x in fine if np.isfinite(x[1]).all() and x[1].any()]
    link = {i: set() for i, *_ in table}
    for i, v, a in fine:
        for j, w, b in fine:
            if i != j and a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                link[i].add(j)
    for i, *_ in table:
        seen, todo = {i}, [i]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(link[i]), min(seen), min(seen) == i)


def test_blocks_give_the_same(spark, monkeypatch):
    df, _ = vectors(spark)
    want = sorted(map(tuple, capfilters.near_duplicates(df).collect()))
    monkeypatch.setattr(capfilters, "BLOCK", 2)
    assert sorted(map(tuple, capfilters.near_duplicates(df).collect())) == want


def test_no_vectors(spark):
    df, _ = vectors(spark)
    assert capfilters.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("number", "dimensions"), [(1_000, 16), (100_000, 64), (1_000_000, 64)])
def test_near_pairs_share_a_direction_at_every_size(number, dimensions):
    rng = np.random.default_rng(99)
    first, aside = rng.standard_normal((2, 400, dimensions))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    aside -= (aside * first).sum(1, keepdims=True) * first
    second = 0.98 * first + np.sqrt(1 - 0.98**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    planned = capfilters.plan(number, dimensions)
    found = [[set(f.tolist()) for f in capfilters.decode(x, *planned)] for x in (first, second)]
    assert np.mean([len(f) for f in found[0]]) >= 0.9 * capfilters.FILTERS
    assert np.mean([bool(a & b) for a, b in zip(*found, strict=True)]) >= 0.985


# -- 4 -------------------------------------------------------------------------------------------------

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    values = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(values) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_plain_regexes(spark):
    rng = random.Random(5)
    parts = ["a@b.c", "1", "2", "+1", "+", ".", "@", "-", " ", "a", "_", "é", "😀", "555-1234", "4111111111111111", "(", "\n", "255.1.1.1", "256.0.0.1", "4111 1111 1111 1111", "000255.1.2.3"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([3, 10, 40]))) for _ in range(800)] + [None, "", "a@b.c " * 300, "1.1.1.1." * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in privacy.op4_pii(df).collect():
        spans = base_spans(texts[r.doc_id] or "")
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_disclosing_terms_go_and_common_ones_stay(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "bravo", "delta"]) for _ in range(5)) + f" contact Johnathan at js@corp.example.org now {i}", 0) for i in range(20)]
    rows += [(100 + i, "alpha contact bravo delta", 25) for i in range(100)] + [(300, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in privacy.sanitise(df).collect()}
    assert all("Johnathan" not in got[i].text and "@" not in got[i].text and "contact" in got[i].text for i in range(20))
    assert got[3].n_chars == len(got[3].text)
    assert got[100].text == "alpha contact bravo delta" and got[300].text is None


def disclosures(texts, support, least):
    """Brute force over the different texts: {term: most that it discloses}."""
    held = {t: ({t[a:b].lower() for a, _, b, _ in base_spans(t)}, {w.lower() for w in re.findall(r"[^\W\d_]+", re.sub(KINDS[0][1], " ", t))}) for t in set(texts)}
    alone = Counter(e for entities, _ in held.values() for e in entities)
    documents = Counter(w for _, words in held.values() for w in words)
    together = Counter((e, w) for entities, words in held.values() for e in entities for w in words)
    worst = {}
    for (e, w), n in together.items():
        if n >= support and alone[e] < len(held):
            value = 1 + math.log(n / documents[w]) / -math.log(alone[e] / len(held))
            if value >= least:
                worst[w] = max(worst.get(w, 0), value)
    return worst


def test_terms_of_whole_texts_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in "aeiou"]
    texts = []
    for i in range(240):
        owner = rng.randrange(6)
        text = [rng.choice(words) for _ in range(rng.choice([5, 40, 90]))]
        if rng.random() < 0.6:
            text.append(f"Owner{'xyzuvw'[owner]}")
        if rng.random() < 0.85:
            text.insert(0, f"p{owner}@mail.example")
        texts.append(" ".join(text))
    texts += texts[:30] * 3 + [None, "", "Ownerx alone, far from all"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = disclosures([t or "" for t in texts], privacy.SUPPORT, privacy.GENERALISE)
    assert want
    for r in privacy.find_personal_data(df).collect():
        text = texts[r.doc_id] or ""
        masked = re.sub(KINDS[0][1], lambda m: " " * len(m[0]), text)
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", masked) if m[0].lower() in want]
        assert [(t.start, t.end) for t in r.terms] == spans
        assert all(math.isclose(t.disclosure, want[text[t.start : t.end].lower()]) for t in r.terms)


# -- 5 -------------------------------------------------------------------------------------------------


def test_edited_texts_and_likeness(docs):
    df, rows = docs
    df = df.dropDuplicates(["doc_id"])
    texts = dict(sorted({i: t or "" for i, t, *_ in rows}.items(), reverse=True))
    ids = list(texts)
    got = {r.doc_id: r for r in fingerprints.op5_fingerprints(df).collect()}
    assert len(got) == len(ids)
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if edited == text:
            assert got[i].near_edited == 1
    assert got[900].fingerprint == got[901].fingerprint == got[5].fingerprint
    assert got[901].near_next == 1


def test_likeness_follows_shared_text():
    rng = random.Random(8)
    rank = np.arange(fingerprints.CLASSES)
    a, b = ("".join(rng.choice("abcdefghij klmnop") for _ in range(20000)).encode() for _ in range(2))
    own = fingerprints.digest(a, rank)
    near = [fingerprints.likeness(own, fingerprints.digest(a[:n] + b[n:], rank)) for n in (20000, 15000, 10000, 5000, 0)]
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[-1] < 0.1


def test_joined_windows_are_those_of_the_whole():
    rng = random.Random(5)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"abcdef gh") for _ in range(rng.choice([0, 1, 40, 63, 64, 65, 130, 900]))) for _ in range(2))
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        got, want = fingerprints.joined_windows(a[:i], b[:j], fingerprints.windows(a), fingerprints.windows(b)), fingerprints.windows(a[:i] + b[:j])
        assert (got.starts == want.starts).all() and (got.kinds == want.kinds).all() and (got.hashes == want.hashes).all()


def test_windows_are_measured_as_told_and_only_chosen_ones_hashed(monkeypatch):
    rng = random.Random(6)
    hashed, hashes = [], fingerprints._hashes
    monkeypatch.setattr(fingerprints, "_hashes", lambda data, starts: hashed.append(len(starts)) or hashes(data, starts))
    rank = np.array(rng.sample(range(fingerprints.CLASSES), fingerprints.CLASSES))
    for text in (b"", b"short", b"a" * 300, bytes(rng.randrange(256) for _ in range(9000)), "".join(rng.choice("abcdé \n") for _ in range(30000)).encode()):
        hashed.clear()
        found = fingerprints.windows(text)
        assert not hashed
        held = [text[s : s + 64].ljust(64, b"\0") for s in found.starts]
        kinds = [min(fingerprints.CLASSES - 1, int(32 * math.fsum(-n / 64 * math.log2(n / 64) for n in Counter(w).values()) + 1e-9)) for w in held]
        assert found.kinds.tolist() == kinds
        order, chosen = rank[kinds].tolist() if kinds else [], Counter()
        for i in range(len(order) - 7):
            chosen[min(range(i, i + 8), key=order.__getitem__)] += 1
        want = [i for i in range(len(order)) if len(order) <= 8 or chosen[i] >= 3]
        got = fingerprints.features(found, rank)
        assert hashed == [len(want)] and got.tolist() == fingerprints.windows(text).hashes[want].tolist()


def test_one_row_is_its_own_next(spark, empty):
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    row = fingerprints.op5_fingerprints(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1
    assert fingerprints.op5_fingerprints(empty).count() == 0


# -- 6 -------------------------------------------------------------------------------------------------


def test_base_scores_and_gain(docs):
    df, rows = docs
    train = Counter()
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(words(t))
    n, v = sum(train.values()), len(train)
    got = classlm.op6_class_lm(df).collect()
    text = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        tokens = words(text[r.doc_id])
        want = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert r.base_score == pytest.approx(want) and r.n_tokens == len(tokens) and r.train_tokens == n
        assert r.n_known == sum(train[w] > 0 for w in tokens) and r.score < 0
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_rare_words_are_joined(docs):
    df, _ = docs
    counts = classlm.count_words(df.select("text")).cache()
    wide = classlm.score(df, classlm.fit(df.select("text"), counts), counts)
    narrow_model = classlm.fit(df.select("text"), counts, lexicon=3)
    narrow = classlm.score(df, narrow_model, counts)
    key = lambda r: (r.doc_id, r.n_known, round(r.base_score, 9))
    assert sorted(map(key, wide.collect())) == sorted(map(key, narrow.collect()))


def test_exchange_separates_two_kinds():
    pairs = np.zeros((4, 4))
    pairs[:2, 2:] = 10
    pairs[2:, :2] = 10
    own = classlm.exchange(pairs, 2)
    assert own[0] == own[1] != own[2] == own[3]


def test_best_classes_raise_mutual_information():
    rng = np.random.default_rng(4)
    number, words = 4, 30
    pairs = rng.poisson(2.0, (words, words)).astype(float)
    np.fill_diagonal(pairs, 0)
    own = rng.integers(0, number, words)

    def information(own):
        joint = np.zeros((number, number))
        np.add.at(joint, (own[:, None], own[None]), pairs)
        log = lambda x: x * np.log(np.maximum(x, 1e-12))
        return log(joint).sum() - log(joint.sum(0)).sum() - log(joint.sum(1)).sum(), joint

    member = np.eye(number)[own]
    best = classlm.best_classes(pairs @ member, pairs.T @ member, own, information(own)[1])
    for w in range(words):
        tried = [information(np.where(np.arange(words) == w, k, own))[0] for k in range(number)]
        assert math.isclose(tried[best[w]], max(tried))


def test_words_beyond_the_first_get_classes_by_their_neighbours(spark):
    rng = random.Random(9)
    left, right = [f"l{i}x" for i in range(40)], [f"r{i}x" for i in range(40)]
    texts = [" ".join(w for _ in range(20) for w in (rng.choice(left), rng.choice(right))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = classlm.count_words(df).cache()
    model = classlm.fit(df, counts, clustered=21, classes=3)
    named = {w: int(c) for w, c in zip(model.lexicon, model.column, strict=True)}
    assert len({named[w.encode()] for w in left}) == 1 and len({named[w.encode()] for w in right}) == 1
    assert named[b"l0x"] != named[b"r0x"]


def test_model_is_normalised(docs):
    df, _ = docs
    counts = classlm.count_words(df.select("text")).cache()
    model = classlm.fit(df.select("text"), counts)
    assert np.allclose((10**model.transition).sum(1), 1)
    held = np.zeros(classlm.CLASSES)
    for r in counts.collect():
        word = bytes(r["word"])
        held[model.classes[classlm._columns([word], model.lexicon, model.column, classlm.CLUSTERED)[1][0]]] += r["n"] + classlm.ADDED
    assert np.allclose(held + classlm.ADDED, 10**model.emission)


def test_no_documents_to_learn_from(empty):
    assert classlm.op6_class_lm(empty).count() == 0


# -- 7 -------------------------------------------------------------------------------------------------


def test_targets_fill_up():
    assert mixing.targets([10, 10, 10]) == pytest.approx([20, 8.333333, 16.666667])
    assert mixing.targets([1, 100, 100]) == pytest.approx([2, 99.833333, 199.666667])
    assert mixing.targets([0, 0]) == [0, 0]


def test_mix_takes_what_it_should(docs):
    df, rows = docs
    got = mixing.op7_mixing(df).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len((t or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.targets([size[s] for s in order]), strict=True))
    source = {i: s for i, _, _, s, _ in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(3, 0.03 * target[s])
    assert sorted(map(tuple, mixing.op7_mixing(df.repartition(7)).collect())) == sorted(map(tuple, got))


@pytest.mark.parametrize("blocks", [4096, 64])
def test_small_sources_meet_their_targets(spark, monkeypatch, blocks):
    # a large source, many of six words, and sources of 0.4, 1 and 1.5 blocks where a block has a word or more
    sizes = {"big": 40_000, **{f"tiny{i:02}": 6 for i in range(40)}, "one": 1, "part": 26, "block": 64, "more": 97, "long": 300, "none": 0, None: 65}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate((s, n) for s, size in sizes.items() for n in ([7] * (size // 7) + [size % 7]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {r.doc_id: r for r in mixing.mix_documents(df, blocks=blocks).collect()}
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for i, text, s in rows:
        assert got[i].source_size == sizes[s] and got[i].size == len(text.split()) and got[i].taken <= 2 * got[i].size
        taken[s] += got[i].taken
        target[s] = got[i].target
    for s, size in sizes.items():
        block = max(1, -(-size // blocks))
        assert abs(taken[s] - target[s]) <= block / 2 + 1e-6, s
    if blocks == 4096:
        import duckdb

        con = duckdb.connect()
        con.register("documents", df.toArrow())
        wanted = con.execute(mixing.ORACLE_SQL).fetchall()
        assert sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in wanted) == sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got.values())


def test_mixed_rows_keep_any_columns(spark):
    rows = [(i, "a b c" if i % 3 else None, f"s{i % 2}", i, "x", 1, 2) for i in range(30)] + [(None, "d e", None, 0, "y", 1, 2)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __row long, __copies string, copies int, doc int")
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} <= set(rows)
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_nothing_to_mix(empty, docs):
    assert mixing.op7_mixing(empty).count() == 0
    df, _ = docs
    assert {r.taken for r in mixing.op7_mixing(df.withColumn("text", F.lit(" "))).collect()} == {0}


# -- 8 -------------------------------------------------------------------------------------------------


def components(rows, words, percent):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set()))
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}, dict(sets)


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_components_equal_brute_force(spark, words, percent):
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(ODD)]
    for _ in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([5, 30, 120, 400]))]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6, len(own) // 10])):
                own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own).title() if rng.random() < 0.2 else " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, sets = components(rows, words, percent)
    got = {r.doc_id: r for r in jaccard.jaccard_components(df, words, percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(3)
    for size in [1, 2, 3, 5, 6, 7, 12, 13, 40, 200, 1500]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            most = 15 * 2 * len(a) // 185
            drop, add = rng.integers(0, most // 2 + 1), rng.integers(0, most + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
            # equal sets are one node
            if not len(b) or np.array_equal(a, b) or not jaccard.linked(a, b, 85):
                continue
            by_band = [{band: set(s.tolist()) for band, s in jaccard.signatures(h, 85)} for h in (a, b)]
            shared = [len(by_band[0][k] & by_band[1][k]) > jaccard.plan(k, 85)[4] for k in by_band[0].keys() & by_band[1].keys()]
            assert any(shared)


def test_sketches_never_tell_linked_sets_apart():
    rng = np.random.default_rng(4)
    for size in [1, 3, 9, 33, 300, 5000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
            b = np.unique(np.concatenate([rng.permutation(a)[rng.integers(0, size // 3 + 1) :], rng.integers(0, 1 << 64, rng.integers(0, size // 3 + 2), np.uint64)]))
            assert jaccard.apart(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_a_hot_group_in_blocks(spark, monkeypatch):
    # one long common passage; near copies of one text that mostly link through others
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = list(passage)
        for at in rng.sample(range(60), rng.choice([1, 1, 2, 3])):
            own[at] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(passage[:20] + [f"y{i}-{k}" for k in range(rng.choice([3, 5, 30]))])) for i in range(60)]
    rows += [(300 + i, t) for i, (_, t) in enumerate(rows[:3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    want, _ = components(rows, 2, 80)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, 2, 80).collect()} == want
    assert len(set(want.values())) < len(rows) - 10


def test_repeated_ids_null_ids_and_kept_columns(spark, empty):
    text = "one two three four five six seven"
    rows = [(1, text, "x"), (1, "something quite different from that", "x"), (2, text, "y"), (3, "something quite different from that", "y"), (None, text, "z"), (4, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.jaccard_components(df).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    kept = jaccard.drop_near_copies(df)
    # texts of one doc_id that aren't linked both stay; the one without doc_id is a copy
    assert kept.columns == df.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, "one two three four five six seven"), (1, "something quite different from that"), (4, "")]
    assert jaccard.jaccard_components(empty).count() == 0


def test_frequent_rows_where_all_are_as_rare(spark):
    counts = spark.createDataFrame([(f"w{i:02}", 1) for i in range(50)], "word string, n long")
    assert sorted(r.word for r in most_frequent(counts, 40).collect()) == [f"w{i:02}" for i in range(40)]
    assert most_frequent(counts.limit(0), 40).count() == 0
    more = counts.unionByName(spark.createDataFrame([("x", 9), ("y", 7)], counts.schema))
    assert {r.word for r in most_frequent(more, 40).collect()} == {"x", "y"}


def test_slices_are_bounded_by_rows_and_bytes(monkeypatch):
    texts = [None, "", "a" * 50, "b" * 5, "c" * 200, "d", "é" * 30, *["e"] * 9]
    monkeypatch.setattr(common, "SLICE_BYTES", 60)
    pieces = list(common.text_slices([pa.RecordBatch.from_pydict({"text": texts})], rows=4))
    assert [t for _, held in pieces for t in held] == [(t or "").encode() for t in texts]
    assert all(p.num_rows == len(held) <= 4 and (len(held) == 1 or sum(map(len, held)) <= 60) for p, held in pieces)


def test_a_scope_frees_what_is_not_kept(spark):
    exists = lambda df: bool(spark.read.parquet(df.staged_at).columns)
    with common.scope() as outer:
        with common.scope() as inner:
            a, b = common.stage(spark.range(2), "scope-a"), inner(common.stage(spark.range(3), "scope-b"))
        assert exists(b)
        with pytest.raises(AnalysisException):
            exists(a)
        c = outer(common.stage(spark.range(4), "scope-c"))
    assert c.count() == 4
    with pytest.raises(AnalysisException):
        exists(b)


def test_components_of_a_long_path(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "src long, dst long")
    assert {r.component_id for r in connected_components(edges).collect()} == {0}


# -- 9 -------------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    rows = ["http://A.Example.NET/en/1?x#y", "http://example.net", "https://www.example.com/de/", "http://x.org/fr/a", "http://notexample.com/de/", "nourl", None, "http://h?q", "ftp://net/", "http://a.net?x=/en/", "http://x.org/de/"] * 4
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.op9_url_filter(df).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(11)] == [
        ("a.example.net", "/en/1", "example.net/en/"), ("example.net", "", None), ("www.example.com", "/de/", "example.com/de/"), ("x.org", "/fr/a", "org/fr/"),
        ("notexample.com", "/de/", None), ("", "", None), ("", "", None), ("h", "", None), ("net", "/", "net/"), ("a.net", "", None), ("x.org", "/de/", None),
    ]
    assert [got[i].verdict for i in (0, 2, 3, 8)] == ["allow", "block", "allow", "block"]
    assert {r.verdict for r in got.values()} == {"allow", "block"}
    assert urls.op9_url_filter(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.op9_url_filter(df.where("page_id = 5")).collect()} == {"allow"}


def test_rates_count_all_labelled_urls(spark):
    rows = [f"http://d{i % 300}.net/{i}" for i in range(900)] + [f"http://d{i % 300}.org/fr/{i}" for i in range(900)] + ["http://hot.net/"] * 900
    pages = urls.with_parts(spark.createDataFrame([(u,) for u in rows], "url string"))
    label = F.when(F.col("host").endswith(".net"), 1.0).otherwise(0.0)
    labelled = urls._lexical(pages).withColumn("label", label).select("url", "suffix", "domain", "head", "label", *(f for f in urls.FEATURES if not f.endswith("_rate")))
    found = urls.fit(labelled, 90)
    rates = {r.domain: r["__rate"] for r in found.rates["domain"].collect()}
    assert rates == pytest.approx({"hot.net": 901 / 902} | {f"d{i}.{s}": (4 if s == "net" else 1) / 5 for i in range(300) for s in ("net", "org")})
    assert found.rate == pytest.approx(2 / 3)
    counted = labelled.groupBy(*labelled.columns).agg(F.count("*").alias("__n"))
    weight = {r.url: r.weight for r in urls.weighed(counted, 90 / 2700).collect()}
    assert 60 <= sum(weight.values()) <= 130 and weight["http://hot.net/"] in (30, 31)


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows = [(i, f"http://{rng.choice(['ads', 'win', 'free'])}{rng.randrange(10**6)}.bad.net/{i}" if i % 2 else f"http://news.site.org/fr/{rng.choice('abc')}") for i in range(400)]
    rows += [(1000 + i, f"http://{rng.choice(['ads', 'win', 'free'])}{rng.randrange(10**6)}.bad.biz/{i}?a=1&b=2") for i in range(50)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(got[1000 + i].verdict == "block" for i in range(50)) >= 45


# -- 10 ------------------------------------------------------------------------------------------------


def call(id_, name="f", after=(), **arguments):
    return f"<tool_call>{json.dumps({'id': id_, 'name': name, 'arguments': arguments, 'after': list(after)})}</tool_call>"


def result(id_, content="ok"):
    return f"<tool_result>{json.dumps({'id': id_, 'content': content})}</tool_result>"


SCHEMAS = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}, "additionalProperties": False}}


def test_odd_json_never_stops_a_message():
    schemas = {"f": {"type": ["object", "null"], "properties": {"n": {"type": ["integer", "null"]}, "k": True, "z": False}}, "g": {"type": "nothing"}}
    call = lambda arguments, name="f": f'<tool_call>{{"id": "a", "name": "{name}", "arguments": {arguments}}}</tool_call>'
    for arguments, name, fits, broken in [
        ('{"n": null}', "f", True, 0), ('{"n": 1, "k": [1]}', "f", True, 0), ('{"n": true}', "f", False, 0), ('{"z": 1}', "f", False, 0), ("null", "f", True, 0), ("{}", "g", False, 0),
        ('{"n": 1e999}', "f", None, 1), ('{"n": -1e999}', "f", None, 1), ('{"n": NaN}', "f", None, 1), ("[" * 100000, "f", None, 1), ('{"n": "\\ud800"}', "f", False, 0),
    ]:
        message, calls, _, malformed = toolcalls.parse("assistant", call(arguments, name), schemas)
        assert malformed == broken and [c["fits"] for c in calls] == ([] if broken else [fits]), arguments
        assert isinstance(json.loads(message), dict) and message.encode()


def test_calls_are_linked_ordered_and_validated(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "b" + call("b", after=["a"], x=1) + call("c", x="no")), (1, 2, "assistant", call("a", x=2, y=3)),
        (1, 3, "tool", result("b") + result("lost")), (1, 4, "tool", result("a")), (2, 0, "tool", result("a")), (2, 1, None, None),
        (3, 0, "assistant", call("p", after=["q"], x=1)), (3, 1, "assistant", call("q", after=["p"], x=1)), (3, 2, "assistant", call("r", after=["q"], x=1)),
        (4, 0, "assistant", "<tool_call>{broken</tool_call> kept"), (4, 0, "assistant", "<tool_call>{broken</tool_call> kept"), (None, 0, "assistant", call("a", x=1)),
    ]
    got = toolcalls.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()
    assert len(got) == len(rows)
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert [(one[t].n_calls, one[t].n_linked, one[t].n_valid, one[t].n_results, one[t].n_orphans) for t in range(5)] == [(0, 0, 0, 0, 0), (2, 1, 1, 0, 0), (1, 1, 0, 0, 0), (0, 0, 0, 2, 1), (0, 0, 0, 1, 0)]
    order = [r.turn for r in sorted(one.values(), key=lambda r: (r.order_turn, r.order_level, r.turn))]
    assert order == [0, 2, 4, 1, 3]
    assert json.loads(one[1].message)["content"] == "b" and one[1].message == toolcalls.canonical(json.loads(one[1].message))
    assert [r.n_orphans for r in got if r.conv_id == 2] == [1, 0]
    assert sorted(r.n_cyclic for r in got if r.conv_id == 3) == [1, 1, 1]
    assert [(r.n_malformed, json.loads(r.message)["content"]) for r in got if r.conv_id == 4] == [(1, "<tool_call>{broken</tool_call> kept")] * 2
    assert [(r.n_calls, r.n_linked) for r in got if r.conv_id is None] == [(1, 0)]


def test_calls_are_validated_by_the_tools_that_conversations_declare(spark):
    tools = lambda *told: f"<tools>{json.dumps(told)}</tools>"
    f, g = {"name": "f", "parameters": SCHEMAS["f"]}, {"name": "g"}
    rows = [
        (1, 0, "system", "Use" + tools(f, g)), (1, 1, "assistant", call("a", x=1) + call("b", x="no") + call("c", "g", y=2) + call("d", "h")), (1, 2, "system", tools({"name": "f", "parameters": False})),
        (2, 0, "assistant", call("a", x=1)), (3, 0, "assistant", call("a", x=1)), (3, 1, "system", tools(f)), (None, 0, "system", tools(f)), (None, 1, "assistant", call("a", x=1)),
        *((4, i, "system", tools({"name": "f", "parameters": p})) for i, p in enumerate([5, {"type": [{}]}, {"required": 1}, {"required": [[]]}, {"enum": 1}, {"properties": []}, {"items": []}, {"properties": {"x": None}}])), (4, 9, "system", '<tools>{"name": "f"}</tools>'),
        (4, 10, "assistant", call("a", x=1)),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in toolcalls.op10_tool_calls(turns).collect()}
    assert len(got) == len(rows)
    assert {k: (r.n_calls, r.n_valid) for k, r in got.items() if r.n_calls} == {(1, 1): (4, 2), (2, 0): (1, 0), (3, 0): (1, 1), (None, 1): (1, 0), (4, 10): (1, 0)}
    assert json.loads(got[1, 0].message) == {"content": "Use", "role": "system", "tools": [f, g | {"parameters": True}]}
    assert all(got[4, i].n_malformed == 1 for i in (*range(8), 9)) and json.loads(got[4, 9].message)["content"] == rows[-2][3]
    # schemas that are given decide for all conversations
    assert {r.conv_id: r.n_valid for r in toolcalls.format_chats(turns, SCHEMAS).collect() if r.conv_id and r.n_calls} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_schema_checks():
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"enum": [1, 2]}}}, "required": ["a"]}
    assert toolcalls.valid({"a": [1, 2], "z": 0}, schema)
    assert not toolcalls.valid({"a": [3]}, schema) and not toolcalls.valid({}, schema) and not toolcalls.valid(True, {"type": "integer"})
