"""Many terms in one pass, corrections by rules, edit distances in bits, and the functions from SQL, each against a plain version."""

import random

import pytest

from folia.functions import matching
from folia.functions.sql import register_functions
from folia.operators import associative, corpus, corrections, planner, search, terms

PAGES = "book string, volume int, source_file string, pdf_page int, printed_page string, raw_text string"


def volumes(seed, letters="ab"):
    rng = random.Random(seed)
    return [(b, v, f"{b}/{v}", p, str(p), rng.choice([None, "", "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))])) for b in ("en", "de") for v in (1, 2) for p in range(1, 30)]


def whole(rows):
    out = {}
    for _, _, file, _, _, text in rows:
        out[file] = out.get(file, "") + (text or "")
    return out


def test_terms_in_one_pass(spark):
    rows = volumes(1)
    pages = corpus.normalized(spark.createDataFrame(rows, PAGES)).repartition(5)
    names = ["ab", "aab", "bb", "ababab", "ab", "zz"]
    got = sorted((r.source_file, r.term, r.length, r.start) for r in terms.term_places(pages, names).collect())
    texts = whole(rows)
    assert got == sorted((f, i, len(t), at) for f, text in texts.items() for i, t in enumerate(names) for at in range(len(text)) if text.startswith(t, at))
    assert terms.term_places(pages, []).count() == 0

    def scan(text, term):
        out, at = [], text.find(term)
        while at >= 0:
            out.append(at)
            at = text.find(term, at + len(term))
        return out

    some = ["ab", "aa", "bab"]
    got = sorted((r.source_file, r.term, r.start) for r in associative.occurrences(pages, some).collect())
    assert got == sorted((f, i, at) for f, text in texts.items() for i, t in enumerate(some) for at in scan(text, t))


def rule_by_rule(volume, page, text, rules):
    applied = ambiguous = 0
    rank = lambda r: (r[2] is not None, r[1] is not None, r[0])
    for rule in sorted(rules, key=rank):
        _, v, p, find, replace, expected, projected = rule
        if projected or v not in (None, volume) or p not in (None, page):
            continue
        if p is None:
            applied += find in text
            text = text.replace(find, replace)
        elif text.count(find) and expected in (None, text.count(find)):
            applied, text = applied + 1, text.replace(find, replace)
        else:
            ambiguous += 1
    places = [i for i, c in enumerate(text) if "一" <= c <= "鿿"]
    seen, edits = "".join(text[i] for i in places), {}
    for _, v, p, find, replace, expected, projected in sorted(rules, key=lambda r: r[0]):
        if projected and (v, p) == (volume, page):
            at = [i for i in range(len(seen)) if seen.startswith(find, i)]
            if at and expected in (None, len(at)):
                applied += 1
                edits |= {places[i + k]: replace[k] for i in at for k in range(len(find)) if find[k] != replace[k]}
            else:
                ambiguous += 1
    return "".join(edits.get(i, c) for i, c in enumerate(text)), applied, ambiguous


@pytest.mark.parametrize("chunk", [50_000, 3])
def test_corrections_equal_rule_by_rule(spark, monkeypatch, chunk):
    monkeypatch.setattr(corrections, "WIDE", chunk)
    rng = random.Random(5)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    pages = [(v, p, rng.choice([None, "", word("天地玄黄，。 a", 40)])) for v in (1, 2) for p in range(1, 12)]
    rules = []
    for i in range(60):
        volume, page = rng.choice([None, 1, 2]), rng.choice([None, *range(1, 12)])
        projected = page is not None and rng.random() < 0.5
        n = rng.randrange(1, 4)
        volume = volume or (1 if page is not None else None)
        rules.append((i, volume, page, word("天地玄黄" if projected else "天地玄黄，a", n), word("宇宙洪荒", n if projected else rng.randrange(0, 3)), rng.choice([None, 1, 2, 3]), projected))
    df = spark.createDataFrame([*rules, (90, None, None, "", "x", 1, False), (91, 1, 2, "天地", "x", 1, True), (92, None, 3, "天", "x", None, False)], "rule_id int, volume int, pdf_page int, find string, replace string, expected int, projected boolean")
    got = corrections.apply_corrections(spark.createDataFrame(pages, "volume int, pdf_page int, raw_text string").repartition(3), df)
    found = {(r.volume, r.pdf_page): (r.corrected, r.applied, r.ambiguous) for r in got.collect()}
    assert len(found) == len(pages)
    for v, p, text in pages:
        assert found[v, p] == ((None, 0, 0) if text is None else rule_by_rule(v, p, text, rules)), (v, p)
    assert [r.rule_id for r in corrections.checked_rules(df).where("NOT fine").orderBy("rule_id").collect()] == [90, 91, 92]


def test_rules_are_merged_once(spark):
    pages = spark.createDataFrame([(1, 1, "天，地天 地天地"), (1, 2, None)], "volume int, pdf_page int, raw_text string")
    rules = spark.createDataFrame([(1, 1, 1, "玄黄", "宇宙", 1, True)], "rule_id int, volume int, pdf_page int, find string, replace string, expected int, projected boolean")
    rows = [(1, 1, 1, "天地", "天他"), (2, 1, 1, "天地", "夫地"), (3, 1, 1, "玄黄", "元黄"), (4, 1, 1, "天", "天"), (5, 1, 1, "天", "天地"), (6, 1, 2, "天", "夫"), (7, 1, 9, "天", "夫"), (8, 1, 1, None, "x"), (9, 1, 1, "地天地", "他天地")]
    got = corrections.merged_rules(rules, spark.createDataFrame(rows, "accepted_id int, volume int, pdf_page int, find string, replace string"), pages).orderBy("accepted_id").collect()
    assert [(r.state, r.expected) for r in got] == [("added", 3), ("duplicate", None), ("duplicate", None), ("degenerate", None), ("degenerate", None), ("unmatched", None), ("unmatched", None), ("degenerate", None), ("added", 1)]


def table(needle, text):
    rows = [[0] * (len(text) + 1)]
    for i, c in enumerate(needle, 1):
        rows.append([i])
        for j, d in enumerate(text, 1):
            rows[i].append(min(rows[i - 1][j - 1] + (c != d), rows[i - 1][j] + 1, rows[i][j - 1] + 1))
    return rows[-1]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("seed", range(30))
def test_bits_equal_the_quadratic_table(seed):
    rng = random.Random(seed)
    needle, text = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (rng.choice([6, 20, 90]), 60))
    assert matching.column_distances(needle, text) == table(needle, text)[1:]
    assert matching.column_distances(needle, text, anchored=True) == [distance(needle, text[:j]) for j in range(1, len(text) + 1)]
    most, before = rng.randrange(0, 4), rng.choice([None, 5, 30])
    parts = [(distance(needle, text[i:j]), i, j) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if before is None or i < before]
    parts = [x for x in parts if x[0] <= most and abs(x[2] - x[1] - len(needle)) <= most]
    assert matching.best_match(needle, text, most, before) == min(parts, default=None)


def test_matches_with_errors_and_their_groups(spark):
    rows = [("en", 1, "en/1", 1, "1", "xx the quick brovn"), ("en", 1, "en/1", 2, "2", ""), ("en", 1, "en/1", 3, "3", "fox jumps yy"), ("de", 1, "de/1", 1, "1", "the quick brown fox jumps"), ("it", 1, "it/1", 4, None, "the quik brown fox jumqs"), ("fr", 1, "fr/1", 1, "1", "nothing like it at all")]
    pages = corpus.normalized(spark.createDataFrame(rows, PAGES))
    got = {(r.book, r.first_page, r.last_page, r.start, r.errors) for r in search.fuzzy_matches(pages, "the quick brown fox jumps").collect()}
    assert got == {("en", 1, 3, 2, 1), ("de", 1, 1, 0, 0), ("it", 4, 4, 0, 2)}
    none = spark.createDataFrame([], "source_file string, title string, pdf_page int, level int, kind string, sort_order int")
    sections = corpus.with_sections(pages.select("source_file", "pdf_page", "printed_page"), none)
    form, facets, groups = planner.grouped_search(pages, sections, corpus.book_dimension(spark), "the quick brown fox jumps")
    assert form == "direct" and {(r.book, r.hits) for r in facets.collect()} == {("de", 1), ("en", 1), ("it", 1)}
    assert [(r.book, r.match_type, r.errors) for r in groups.collect()] == [("en", "fuzzy", 1), ("de", "exact", 0), ("it", "fuzzy", 2)]


def test_functions_from_sql(spark):
    register_functions(spark)
    one = lambda sql: spark.sql(f"SELECT {sql} AS x").first()["x"]
    assert one("nfkc('ＡＢ①')") == "AB1" and one("norm_text(' Ａ，b。　c ')") == "Abc" and one("norm_text(NULL)") is None
    assert one("find_all('aaaa', 'aa', true)") == [0, 1, 2] and one("find_all('aaaa', 'aa', false)") == [0, 2] and one("find_all('a', '', true)") == [] and one("find_all(NULL, 'a', true)") is None
    assert one("edit_le('kitten', 'a sitten here', 2)") == 1 and one("edit_le('kitten', 'xyz', 2)") is None and one("edit_le('', 'xyz', 0)") == 0
    assert tuple(one("best_window(array(50L, 0L, 55L, 300L), array(3, 3, 4, 2), array(1, 1, 2, 3), 200)")) == (2, 0, 59)
    assert tuple(one("best_window(array(), array(), array(), 200)")) == (None, None, None)
    rows = volumes(7)
    pages = corpus.normalized(spark.createDataFrame(rows, PAGES)).repartition(4)
    pages.createOrReplaceTempView("located_pages")
    for query in ("ab", "a b a", "bbab"):
        got = sorted(tuple(r) for r in spark.sql("SELECT source_file, start, first_page, last_page FROM locate(TABLE(located_pages), :q)", args={"q": query}).collect())
        assert got == sorted((r.source_file, r.start, r.first_page, r.last_page) for r in search.match_spans(pages, query).collect()) and got
    assert spark.sql("SELECT * FROM locate(TABLE(located_pages), 'a')").count() == 0
