"""Source divergence against a plain dense computation and against its SQL."""

import random
import re
from collections import Counter, defaultdict
from itertools import product

import duckdb
import pytest

from folia.llm import divergence

SCHEMA = "lang string, source string, text string, rank int, term string"


def brute_force(docs):
    seen, holds, groups = defaultdict(Counter), Counter(), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        seen[lang, source].update(terms)
        holds.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (at, t), n in holds.items() if at == lang and n >= 30]
        sources = [s for at, s in groups if at == lang]
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * len(kept)) for t in kept}
        of = {s: share(seen[lang, s]) for s in sources}
        whole = share(sum((seen[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [("pair", o, sum(abs(of[s][t] - of[o][t]) for t in kept)) for o in sources if o != s]
            terms = [("term", t, of[s][t] - whole[t]) for t in kept if seen[lang, s][t] and of[s][t] > whole[t]]
            for part, most in ((pairs, None), (terms, 50)):
                part.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, i + 1) for i, x in enumerate(part[:most])]
    return sorted(map(repr, out))


def documents():
    rng = random.Random(2)
    words = [f"{a}{b}" for a, b in product("bcdfghjklm", "aeiouéß日")]
    docs = []
    for i in range(700):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice(["s1", "s2", "s2", "s2", "s3", None, "ü"])
        few = words[: 20 + 10 * len(source or "")] if i % 3 else words
        docs.append((lang, source, " ".join(rng.choice(few) for _ in range(rng.choice([1, 5, 30])))))
    docs += [("en", "empty", None), ("en", "dígits", "1 2 3 -"), ("fr", "alone", "un deux"), ("es", "a", "hola"), ("es", "b", ""), ("", "s9", "Ba BA ba\x00ba")]
    docs += [("en", "copies", "same same text")] * 40 + [("en", "s1", " ".join(rng.choice(words) for _ in range(4000)))]
    return docs


@pytest.fixture(scope="module")
def table(spark):
    docs = documents()
    return docs, spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA).repartition(6).cache()


@pytest.mark.parametrize(("text", "shard", "groups"), [(4 << 20, 200_000, 20_000), (900, 40, 3), (60, 1, 1)])
def test_audit_equals_brute_force(table, monkeypatch, text, shard, groups):
    # small parts: long texts in pieces, shards of single terms, rounds over groups
    for name, value in (("TEXT", text), ("SHARD", shard), ("GROUPS", groups)):
        monkeypatch.setattr(divergence, name, value)
    docs, df = table
    got = divergence.op13_divergence(df)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_force(docs)


def test_sql_equals_brute_force(table):
    docs, df = table
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert sorted(map(repr, con.execute(divergence.ORACLE_SQL).fetchall())) == brute_force(docs)


def test_no_documents(table):
    assert divergence.op13_divergence(table[1].limit(0)).count() == 0
