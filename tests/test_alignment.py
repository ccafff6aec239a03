"""Volumes with substitutions, insertions, omissions, moved and blank pages against an alignment of whole texts."""

import random
from difflib import SequenceMatcher

import pytest

from folia.operators import alignment

UNIT = "volume string, unit int, text string"
#: Units 12 and 14 change places, so only one of these can stay.
PASSED = (12, 13, 14)


def whole(ocr, authority):
    """What one alignment of the whole texts tells: (unit, ocr, auth, find, replace)."""
    keep = lambda t: "".join(c for c in t or "" if "一" <= c <= "鿿")
    one, other = "".join(keep(t) for _, t in ocr), "".join(keep(t) for _, t in authority)
    owner = [u for u, t in ocr for _ in keep(t)]
    found = set()
    for tag, a, b, c, d in SequenceMatcher(None, one, other, autojunk=False).get_opcodes():
        if tag == "replace" and b - a == d - c <= 2:
            left, right = one[max(0, a - 3) : a], one[b : b + 3]
            found.add((owner[a], one[a:b], other[c:d], left + one[a:b] + right, left + other[c:d] + right))
    return found


@pytest.mark.parametrize(("piece", "part"), [(1024, 4096), (32, 48)])
def test_volumes_equal_whole_alignments(spark, monkeypatch, piece, part):
    monkeypatch.setattr(alignment, "PIECE", piece)
    monkeypatch.setattr(alignment, "PART", part)
    ocr_rows, auth_rows, want, own = [], [], set(), set()
    for seed in range(3):
        rng, volume = random.Random(seed), f"v{seed}"
        text = lambda n, r=rng: "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))
        works = [(i, text(rng.randrange(150, 400))) for i in range(6)]
        stream = "".join(t for _, t in works)
        pages = [stream[i : i + 90] for i in range(0, len(stream), 90)]
        for n in range(0, len(pages), 2):
            p = list(pages[n])
            for at in (30, 60):
                if at + 14 < len(p):
                    k = rng.choice((1, 1, 2, 3))
                    p[at : at + k] = text(k)
            pages[n] = "".join(p)
        del pages[5]
        pages.insert(9, text(70))
        pages.insert(3, "")
        pages.insert(4, "no such letters, 12\n")
        pages[12], pages[14] = pages[14], pages[12]
        ocr = [(i, "\n".join(p[j : j + 20] + "，x" for j in range(0, len(p), 20)) if p else None) for i, p in enumerate(pages)]
        ocr_rows += [(volume, *r) for r in ocr]
        auth_rows += [(volume, *r) for r in works]
        want |= {(volume, *r) for r in whole(ocr, works)}
        own |= {(volume, *r) for u in PASSED for r in whole([ocr[u]], works)}
    # volumes that one side alone has, and one without any common gram
    ocr_rows += [("alone", 0, "甲乙丙" * 20), ("strange", 0, "子丑寅卯" * 9)]
    auth_rows += [("other", 0, "甲乙丙" * 20), ("strange", 0, "辰巳午未" * 9)]
    found = alignment.substitutions(spark.createDataFrame(ocr_rows, UNIT), spark.createDataFrame(auth_rows, UNIT)).drop("at").collect()
    got = {tuple(r) for r in found}
    stays = lambda rows: {r for r in rows if r[1] not in PASSED}
    assert len(stays(want)) > 20 and stays(got) == stays(want) and len(found) == len(got)
    # which of the units that passed each other stay in the chain is open; what is told of them is true
    assert got - stays(got) <= own


def test_no_volumes(spark):
    none = spark.createDataFrame([], UNIT)
    assert alignment.substitutions(none, none).collect() == []


def test_the_heaviest_chain_rises_in_both(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for volume in range(20):
        own, at = [], 0
        for _ in range(rng.randrange(1, 9)):
            size = rng.randrange(12, 40)
            own.append((volume, at, at + size, rng.randrange(0, 200) - at, rng.randrange(1, 9)))
            at += size + rng.randrange(0, 20)
        rows += own
        best = 0
        for mask in range(1 << len(own)):
            chain = [r for i, r in enumerate(own) if mask >> i & 1]
            if all(x[2] + x[3] <= y[1] + y[3] + alignment.GRAM - 1 for x, y in zip(chain, chain[1:], strict=False)):
                best = max(best, sum(r[4] for r in chain))
        want[volume] = best
    got = {}
    for r in alignment.chained(spark.createDataFrame(rows, "volume int, a long, b long, shift long, n long")).orderBy("volume", "a").collect():
        got.setdefault(r["volume"], []).append(r)
    assert {v: sum(r["n"] for r in rs) for v, rs in got.items()} == want
    assert all(x["b"] + x["shift"] <= y["a"] + y["shift"] + alignment.GRAM - 1 for rs in got.values() for x, y in zip(rs, rs[1:], strict=False))


def test_anchors_meet_in_one_grouping(spark, monkeypatch):
    monkeypatch.setattr(alignment, "DENSITY", 1)
    rng = random.Random(9)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(200))
    rows = [("v", 0, text), ("w", 0, text[:50] * 2), (None, 0, text)]
    other = [("v", 0, text[:80]), ("v", 1, "x" + text[90:]), ("w", 0, text[:50]), (None, 0, text)]
    placed = [alignment.placed(spark.createDataFrame(r, UNIT)) for r in (rows, other)]
    found = alignment.runs(*[spark.createDataFrame(p.collect(), p.schema) for p in placed])
    # grams are grouped once for both sides and never sorted to be joined
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    # a gram that stands twice on one side is no anchor; what crosses the repeat stands on one side alone
    assert {(r.volume, r.a, r.b, r["shift"], r.n) for r in found.collect()} == {("v", 0, 80, 0, 69), ("v", 90, 200, -10, 99)}
