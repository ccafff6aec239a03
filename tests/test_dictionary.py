"""Dictionaries: a plain walk over all lines gives the same entries as the joins."""

import random
import re

import pytest

from folia.operators import dictionary

NAME, PAGE = "大辞典", "source_file string, page int, text string"
SKIPPED = set("《》〈〉<>()（）“”‘’\"'[]【】，、。；：！？—–·・•…")
HAN = re.compile("[一-鿿]")


def significant(lines, i):
    """(line, place, character) of what counts in a line and the three after it."""
    return [(j, k, c) for j in range(i, min(i + 4, len(lines))) for k, c in enumerate(lines[j]) if not c.isspace() and c not in SKIPPED]


def foreign(text):
    return text[:1] in ("(", "（") and bool(re.search("[A-Za-z]{2}", text[:90]))


def line_heading(lines, i, title):
    name, signs = [c for c in title if not c.isspace() and c not in SKIPPED], significant(lines, i)
    if not name or len(signs) < len(name):
        return None
    wrong = [k for k, (sign, c) in enumerate(zip(signs, name, strict=False)) if sign[2] != c]
    if wrong and not (len(name) >= 10 and len(wrong) == 1 and 0 < wrong[0] < len(name) - 1 and HAN.match(name[wrong[0]]) and HAN.match(signs[wrong[0]][2])):
        return None
    line, place, _ = signs[len(name) - 1]
    tail = lines[line][place + 1 :]
    rest = tail.lstrip("》〉>)）”\" \t　")
    if rest and rest[0] not in "(（☆" and not rest[0].isascii():
        return None
    marked = "《" in "".join(lines[i : line + 1])[: "".join(lines[i : line + 1]).index(name[0] if 0 not in wrong else signs[0][2])] and len(tail.replace(" ", "")) > len(rest.replace(" ", ""))
    begins = line if rest else line + 1
    return begins, rest, marked, foreign(rest or (lines[begins] if begins < len(lines) else ""))


def person_heading(lines, i, title):
    if not re.fullmatch("[一-鿿]{2,8}", title):
        return None
    line = lines[i].replace(" ", "")
    for dot in "·・•":
        at = line.find(dot + title)
        after = line[at + 1 + len(title) :]
        if 0 <= at <= 20 and (re.match(r"[(（][^)）]*[)）]([(（]|$)", after) or re.fullmatch(r"[(（][^)）]*", after) and re.search("[A-Za-z]{2}", after) or not after and i + 1 < len(lines) and re.match("[(（].*[A-Za-z]{2}", lines[i + 1])):
            return i, "", False, True
    return None


def within(lines, i, title):
    line = lines[i].replace(" ", "")
    at = line.find(title)
    if len(title) < 3 or not 0 < at <= 24 or line[at + len(title) : at + len(title) + 1] not in ("(", "（"):
        return None
    seen = k = 0
    while seen < at + len(title):
        seen += lines[i][k] != " "
        k += 1
    return i, lines[i][k:].strip(), False, foreign(lines[i][k:].strip())


def plain(titles, pages):
    """title, first line's place, text lines, last page and whether found, of each (title, page)."""
    lines = [(p, x.strip(), x.startswith("　")) for p in sorted(pages) for x in pages[p].split("\n") if x.strip() and not x.strip().isdigit()]
    texts, out = [x for _, x, _ in lines], []
    tries = lambda i, t: line_heading(texts, i, t) or person_heading(texts, i, t) or within(texts, i, t)
    for title, page in titles:
        here = [m for i, (p, _, _) in enumerate(lines) if page <= p <= page + 8 and (m := tries(i, title))]
        before = [(i, m) for i, (p, _, _) in enumerate(lines) if p == page - 1 and (m := tries(i, title))]
        best = next((m for m in here if m[3]), here[0] if here else None)
        if best is None and before and page > 2:
            m = next((m for _, m in before if m[3]), before[0][1])
            of = [i for i, (p, _, _) in enumerate(lines) if p == page - 1]
            best = m if m[0] - of[0] >= len(of) - 12 else None
        span = [i for i, (p, _, _) in enumerate(lines) if page <= p <= page + 8]
        start = best[0] if best else next((i for i in span if lines[i][2]), span[0] if span else None)
        if start is None:
            out.append((title, [], page, False, False))
            continue
        heads = [i for i in span if i > start for t, q in titles if t != title and q == lines[i][0] and ((m := line_heading(texts, i, t)) and m[3] or person_heading(texts, i, t))]
        end = min(heads, default=None)
        held = [i for i, (p, _, _) in enumerate(lines) if i >= start and p <= page + 8 and (end is None or i < end)]
        said = [best[1] if best and best[1] and i == start else texts[i] for i in held]
        out.append((title, said, max([lines[i][0] for i in held], default=page), bool(best), end is not None))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_entries_equal_a_plain_walk(spark, seed):
    r = random.Random(seed)
    word = lambda a, b: "".join(r.choice("论学史哲国家社会主义") for _ in range(r.randint(a, b)))
    titles = list({(word(2, 12), r.randint(2, 14)) for _ in range(40)})
    pages = {p: [] for p in range(2, 16) if p != 9}
    for title, page in titles:
        page = page - (r.random() < 0.15)
        if page not in pages or r.random() < 0.1:
            continue
        shown = title[:4] + "错" + title[5:] if len(title) > 10 and r.random() < 0.5 else title
        form = r.randrange(6)
        head = {0: [f"{shown} (Name {seed}x)"], 1: [f"《{shown[:2]}", f"{shown[2:]}》(Nam(e)s)"], 2: [f"安·{shown}(Ann)(1900)"], 3: [f"前文又{shown}（Abc）后"], 4: [shown, "(Next line)"], 5: [f"{shown}☆参见12页"]}[form]
        pages[page] += [*head, *[r.choice(["　　", ""]) + word(3, 20) + "，" for _ in range(r.randint(0, 6))]]
    pages = {p: "\n".join([str(p), *x]) for p, x in pages.items()}
    index = spark.createDataFrame([("d", 1, "\n".join(f"{t}⋯⋯{p}" for t, p in titles))], PAGE)
    body = spark.createDataFrame([("d", p, t) for p, t in pages.items()], PAGE)
    got = dictionary.build_dictionary(index, body, NAME).orderBy("sort_order").collect()
    want = plain(titles, pages)
    assert len(got) == len(want) > 25
    flat = lambda text: re.sub(r"\s", "", text)
    for row, (title, said, last, found, ended) in zip(got, want, strict=True):
        whole = flat("".join(said)).replace("（", "(").replace("）", ")")
        gloss = flat(row.english)
        assert row.index_title == title
        assert (row.end_page, "title_not_found" not in row.issues, "next_heading_not_found" not in row.issues) == (last, found, ended), (title, row)
        rest = whole.replace(f"({gloss})", "", 1) if gloss else whole
        assert flat(row.content).replace("(", "").replace(")", "").replace(",", "，") == rest.replace("(", "").replace(")", "").replace(",", "，"), (title, row)


def test_brackets_glosses_and_paragraphs(spark):
    cases = {"《资本论》": ("《资本论》", True), "《论《资本论》》": ("《论〈资本论〉》", True), "《论(一)》": ("《论(一)》", True), "《甲〉": ("《甲》", True), "（甲)": ("(甲)", True), "<甲）": ("(甲)", True), "〈甲>": ("〈甲〉", True), "《甲": ("《甲", False), "甲》": ("甲》", False), "": ("", True), "<甲>": ("<甲>", True), "《论(一）》": ("《论〈一〉》", True)}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").repartition(2).select("t", dictionary.brackets("t").alias("b")).collect()
    assert {x.t: tuple(x.b) for x in rows} == cases
    glosses = {"联共(布)(the C.P.S.U.(B))是": ("the C.P.S.U.(B)", "联共(布)是"), "(Karl Marx〕马": ("Karl Marx", "马"), "(1818—1883)(Marx)": ("Marx", "(1818—1883)"), "无": ("", "无"), "(": ("", "("), "()": ("", "()"), "字" * 49 + "(Late)": ("", "字" * 49 + "(Late)"), "(a中b)": ("", "(a中b)")}
    rows = spark.createDataFrame([(k,) for k in glosses], "t string").select("t", dictionary.gloss("t").alias("g")).collect()
    assert {x.t: tuple(x.g) for x in rows} == glosses
    texts = {"中 国, 好！ 的wo- rd 12??34 5?? ??": ("中国，好！的word 12%—34 5%", ["auto_fix:question_marks"]), "中因。 \n\n□\n\n列宇": ("中国。\n\n列宁", ["auto_fix:中因->中国", "auto_fix:列宇->列宁"]), "": ("", []), "ＡＢ　c": ("AB c", [])}
    rows = spark.createDataFrame([(k,) for k in texts], "t string").select("t", dictionary.polished("t").alias("p")).collect()
    assert {x.t: (x.p.text, sorted(x.p.issues)) for x in rows} == {k: (v, sorted(i)) for k, (v, i) in texts.items()}


def test_empty_and_odd_pages(spark):
    none = spark.createDataFrame([], PAGE)
    assert dictionary.build_dictionary(none, none, NAME).count() == 0
    index = spark.createDataFrame([("d", 1, "甲⋯⋯2\n甲⋯⋯2\n9999\n" + "长" * 81 + "⋯3\n乙 \n３\n丙\nB\n丁⋯⋯４"), ("d", 2, None)], PAGE)
    rows = dictionary.index_entries(index, NAME, 20).orderBy("sort_order").collect()
    assert [(x.title, x.letter, x.start_page, x.sort_order) for x in rows] == [("甲", "#", 2, 1), ("乙", "#", 3, 3), ("丁", "B", 4, 4)]
    built = dictionary.build_dictionary(index, spark.createDataFrame([("d", 2, None), ("e", 2, "甲(Name)")], PAGE), NAME, last_page=20)
    assert {(x.index_title, x.content, x.end_page) for x in built.collect()} == {("甲", "", 2), ("乙", "", 3), ("丁", "", 4)}
    assert [tuple(x) for x in dictionary.dictionary_report(built).collect()] == [("d", 3, 3, 0, 0)]
    volumes = spark.createDataFrame([("up", 48, "a"), ("low", 1, "b"), ("low", 2, "c"), ("other", 2, "d")], "source_file string, pdf_page int, text string")
    assert {tuple(x) for x in dictionary.printed_pages(volumes, "d", [("up", 2, 711, 46), ("low", 712, 1354, -711)]).collect()} == {("d", 2, "a"), ("d", 712, "b"), ("d", 713, "c")}
