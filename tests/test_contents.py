"""Contents from the corpus: a plain parser, exhaustive assignments and sequential pairing give the same."""

import difflib
import random
import re
import unicodedata
from itertools import combinations

import pytest

from folia.operators import contents

PAGES = "source_file string, pdf_page int, printed_page string, raw_text string"
MARKS = "source_file string, mark_no int, title string, pdf_page int, level int"
NOISE = {"目录", "插图目录", "插图", "封面", "书名", "书名页", "版权", "版权页"}
NUMERIC = r"[0-9IVXLCDMivxlcdm\s\-—–\.]+"
SIGNS, SPAN = r"[IVXLCDMivxlcdm\d]+", r"\s*[-—–~～至]+\s*"


def tidy(text):
    return " ".join(unicodedata.normalize("NFKC", text).replace("\x00", "").split())


def number(sign):
    if sign.isdigit():
        return sign if len(sign) <= 4 and 1 <= int(sign) <= 3000 else None
    return "pre-" + sign.lower() if re.fullmatch("[ivxlcdmIVXLCDM]{1,10}", sign) else None


def entry_of(line):
    line = tidy(line).replace("—", "-").replace("–", "-")
    for form in (rf"(.+?)(?:[·•∙⋯…\.\s]{{2,}}|[·•∙⋯…\.]+\s*)({SIGNS})(?:{SPAN}{SIGNS})?\s*", rf"(.+?)\s+({SIGNS}){SPAN}{SIGNS}\s*", rf"(.+?)\s+({SIGNS})\s*"):
        m = re.fullmatch(form, line)
        if m and tidy(m[1]) and number(m[2]):
            return tidy(m[1]), number(m[2])
    return line, None


def is_noise(text):
    return text.replace(" ", "") in NOISE or bool(re.fullmatch(NUMERIC, text))


def plain_contents(pages, marks):
    """Entries of one file, line by line."""
    texts = {p: t for _, p, _, t in pages}
    lines = {p: [tidy(x) for x in (t or "").splitlines() if tidy(x)] for p, t in texts.items()}
    hits = lambda p: sum(entry_of(x)[1] is not None for x in lines.get(p, []))
    opens = lambda p: "目录" in "".join(lines.get(p, [])[:4]).replace(" ", "") and hits(p) >= 3
    seeds = [m[3] for m in sorted(marks, key=lambda m: m[1]) if "目录" in tidy(m[2]).replace(" ", "")] or range(1, 41)
    start = next((p for p in seeds if opens(p)), None)
    if start is None:
        return []
    end = start
    while end < start + 7 and (opens(end + 1) or hits(end + 1) >= 6):
        end += 1
    places = {}
    for _, p, printed, _ in sorted(pages, key=lambda r: r[1]):
        if printed:
            places.setdefault(printed, p)
    for m in sorted(marks, key=lambda m: m[1]):
        if number(tidy(m[2])):
            places.setdefault(number(tidy(m[2])), m[3])
    out, carry = set(), ""
    for p in range(start, end + 1):
        for line in lines[p]:
            if is_noise(line):
                continue
            title, token = entry_of(line)
            if token is None:
                author = line.replace(" ", "").startswith(("卡·马克思", "弗·恩格斯", "马克思", "恩格斯")) and len(line) <= 24
                carry = "" if author or len(line) <= 2 else carry + line
                continue
            title, carry = tidy(carry + title), ""
            if not is_noise(title) and token in places:
                out.add((places[token], title))
    return sorted(out)


def volume(rng, file):
    words = ["论", "权威", "资本 论", "第一章", "general", "notes", "国家", "批判", "序 言", "Ⅱ"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
    first = rng.choice([2, 5, 30, 39, 41])
    pages = [(file, p, None if p < 6 else f"pre-{'ivx'[p % 3]}" if p < 9 else str(p - 5) if p % 9 else None, f"正文 {p}\n{title()}") for p in range(1, 60)]
    for k in range(rng.randrange(1, 5)):
        lines = ["目 录" if rng.random() < 0.9 else "x"] if not k else []
        for _ in range(rng.randrange(8, 30)):
            lines.append(rng.choice([
                f"{title()}……{rng.randrange(1, 50)}", f"{title()} .... {rng.randrange(1, 50)}—{rng.randrange(50, 60)}", f"{title()}　{rng.randrange(1, 70)}", f"{title()} {rng.randrange(1, 9)}-{rng.randrange(9, 20)}",
                title(), title(), "卡·马克思 论文", "12", "插图目录", "ab", "", " \x1c ", f"{title()}…iv", f"{title()} 3001", "１２３  　４５",
            ]))
        pages[first - 1 + k] = (file, first + k, None, "\r\n".join(lines) if k % 2 else "\n".join(lines))
    marks = [(file, i, rng.choice(["12", "（xv）", "目 录", "章 节", "[7]", "序"]), rng.randrange(1, 60), rng.randrange(0, 3)) for i in range(rng.randrange(0, 6))]
    if rng.random() < 0.4:
        marks.append((file, 9, "本书目录", first, 1))
    return pages, marks


def test_parsed_contents_equal_a_plain_parser(spark):
    rng = random.Random(11)
    volumes = {f"v{i}": volume(rng, f"v{i}") for i in range(40)}
    pages = spark.createDataFrame([p for v in volumes.values() for p in v[0]], PAGES).repartition(5)
    marks = spark.createDataFrame([m for v in volumes.values() for m in v[1]], MARKS)
    got = {}
    for r in contents.parsed_contents(pages, marks).collect():
        got.setdefault(r["source_file"], []).append((r["sort_order"], r["pdf_page"], r["title"]))
    wanted = {f: plain_contents(*v) for f, v in volumes.items()}
    assert sum(map(len, wanted.values())) > 60
    for f, entries in wanted.items():
        assert [x[1:] for x in sorted(got.get(f, []))] == entries, f


def test_contents_are_chosen_in_order(spark):
    rng = random.Random(3)
    volumes = {f: volume(rng, f) for f in ("given", "marks", "few", "none")}
    page_rows = [p for v in volumes.values() for p in v[0]]
    lines = "\n".join(["目录", "一论 …… 3", "二论 …… 5", "三论 …… 7"])
    page_rows = [(f, p, str(p), lines if f == "few" and p == 2 else t if f != "none" else "x") for f, p, _, t in page_rows]
    marks = [(f, i, f"章 {chr(97 + i)}n", i + 1, 0) for f in ("given", "marks") for i in range(12)] + [(f, i, "章 z", 9, 2) for f in ("few", "none") for i in range(3)]
    entries = spark.createDataFrame([("given", "own", 4, 2, 1)], "source_file string, title string, pdf_page int, level int, sort_order int")
    got = contents.chosen_contents(entries, spark.createDataFrame(page_rows, PAGES), spark.createDataFrame(marks, MARKS)).collect()
    found = {f: sorted((r["origin"], r["pdf_page"], r["title"], r["level"]) for r in got if r["source_file"] == f) for f in volumes}
    assert found["given"] == [("given", 4, "own", 2)]
    assert len(found["marks"]) == 12 and {x[0] for x in found["marks"]} == {"marks"} and {x[3] for x in found["marks"]} == {1}
    assert found["few"] == [("parsed", 3, "一论", 1), ("parsed", 5, "二论", 1), ("parsed", 7, "三论", 1)]
    assert found["none"] == [("marks", 9, "章 z", 2)]


def test_dates_end_entries():
    lines = ["目 录", "一、前进", "的路", "论改革……", "开放······3", "（2012年12月7日—11日）", "第二卷", "短", "长的标题一二三四五六 12", "(2013年1月5日)", "（2013年1月6日）", "没有页", "7（2014年3月1日）", "二、再论 9", "尾声一二三四五 33"]
    assert contents.dated_entries(lines) == [
        ("section", "一、前进的路", None), ("body", "论改革……开放", 3), ("body", "短长的标题一二三四五六", 12), ("body", "没有页", 7), ("section", "二、再论", None), ("body", "尾声一二三四五", 33),
    ]


def exhaustive(candidates):
    best = 0.0
    for n in range(len(candidates) + 1):
        for some in combinations(candidates, n):
            some = sorted(some)
            if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(some, some[1:])):
                best = max(best, sum(c[2] for c in some))
    return best


@pytest.mark.parametrize("seed", range(40))
def test_chains_weigh_as_much_as_any(seed):
    rng = random.Random(seed)
    candidates = list({(rng.randrange(6), rng.randrange(7)): rng.choice([1.0, 0.55, 0.7, rng.random()]) for _ in range(rng.randrange(0, 12))}.items())
    candidates = [(*k, w) for k, w in candidates]
    chain = contents.best_chain(candidates)
    weight = {c[:2]: c[2] for c in candidates}
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:]))
    assert sum(weight[c] for c in chain) == pytest.approx(exhaustive(candidates))


def test_titles_are_located_in_order_and_with_errors(spark):
    titles = ["关于反对党八股问题的讲话", "论联合政府和人民民主", "在延安文艺座谈会上的讲话", "矛盾论", "为人民服务而作的演说", "愚公移山的故事和启示", "没有的篇章标题在这里"]
    heads = {3: "12 关于反对党八股\n问题的讲话 一九四二年", 5: "矛盾论 又见", 7: "论联合政府和人民民主专政", 9: "在延安文艺痤谈会止的讲话", 12: "矛盾论", 15: "页眉 为人民服务而作的演说", 18: "愚公移出的故享和启示 x", 20: "关于反对党八股问题的讲话"}
    pages = spark.createDataFrame([("a", p, str(p), heads.get(p, f"普通的正文第{p}页")) for p in range(1, 25)] + [("b", 1, "1", None)], PAGES)
    entries = spark.createDataFrame([(f, i + 1, t) for f in ("a", "b") for i, t in enumerate(titles)], "source_file string, entry_no int, title string")
    got = {(r["source_file"], r["entry_no"]): r["pdf_page"] for r in contents.located_entries(entries, pages).collect()}
    assert [got["a", i + 1] for i in range(7)] == [3, 7, 9, 12, 15, 18, None]
    assert {got["b", i + 1] for i in range(7)} == {None}


def test_dated_contents_from_pages_to_places(spark):
    toc = ["目录", "一、前进的路", "论改革开放的深化……3", "（2012年12月7日）", "再论开放 5", "（2013年1月5日）"]
    toc2 = ["三论发展的目标 8", "（2013年2月5日）", "四论失落的页 9", "（2013年3月5日）"]
    texts = {2: "\n".join(toc), 3: "\n".join(toc2), 4: "正文（2013年3月5日）", 7: "论改革开放的深化\n正文", 9: "再论开放", 12: "三论发展的目标"}
    pages = spark.createDataFrame([("a", p, None, texts.get(p, f"第{p}页")) for p in range(1, 20)], PAGES)
    entries = contents.dated_contents(pages)
    assert [(r.entry_no, r.kind, r.title, r.page, r.ends_at) for r in entries.orderBy("entry_no").collect()] == [
        (1, "section", "一、前进的路", None, 3), (2, "body", "论改革开放的深化", 3, 3), (3, "body", "再论开放", 5, 3), (4, "body", "三论发展的目标", 8, 3), (5, "body", "四论失落的页", 9, 3),
    ]
    got = contents.placed_contents(entries, pages).orderBy("entry_no").collect()
    assert [(r.entry_no, r.pdf_page) for r in got] == [(1, 7), (2, 7), (3, 9), (4, 12), (5, 13)]


def test_pairs_equal_the_sequential_greedy(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("天地玄黄宇宙洪") for _ in range(rng.randrange(2, 9)))
    titles = [("ab"[i % 2], i, word()) for i in range(60)]
    marks = [("ab"[i % 2], i, rng.choice([word(), titles[rng.randrange(60)][2]])) for i in range(50)]
    got = contents.paired_titles(spark.createDataFrame(titles, "source_file string, title_no int, title string"), spark.createDataFrame(marks, "source_file string, mark_no int, title string"))
    wanted, used = set(), set()
    for f, i, t in titles:
        best = (0.0, None)
        for g, j, m in marks:
            r = difflib.SequenceMatcher(None, t, m, autojunk=False).ratio()
            if g == f and (g, j) not in used and r > best[0]:
                best = (r, j)
        if best[0] >= 0.55:
            used.add((f, best[1]))
            wanted.add((f, i, best[1]))
    assert {tuple(r) for r in got.collect()} == wanted and len(wanted) > 20


def test_detected_chapters_and_printed_titles_are_merged(spark):
    texts = {3: "12\n论 持久战（一九三八年五月）正文", 4: "论持久战（一九三八年五月）", 6: "实践。论（一九三七年七月）", 8: "新民主主义论\n(一九四〇年一月九日)", 11: "整顿党的作风 讲话", 14: "反对本本主义（一九三〇年五月）"}
    pages = spark.createDataFrame([("a", p, None if p < 3 else str(p), texts.get(p, "正文")) for p in range(1, 20)], PAGES)
    detected = contents.detected_chapters(pages)
    assert [(r.pdf_page, r.title) for r in detected.orderBy("pdf_page").collect()] == [(3, "论持久战"), (8, "新民主主义论"), (14, "反对本本主义")]
    printed = spark.createDataFrame([("a", i, t) for i, t in enumerate(["论持久战", "新民主主义", "整顿党的作风", "不在书里的"])], "source_file string, title_no int, title string")
    got = contents.merged_contents(detected, printed, pages).orderBy("pdf_page").collect()
    assert [(r.pdf_page, r.title, r.origin) for r in got] == [(3, "论持久战", "detected"), (8, "新民主主义论", "detected"), (11, "整顿党的作风", "printed"), (14, "反对本本主义", "detected")]


def test_no_pages(spark):
    pages, marks = spark.createDataFrame([], PAGES), spark.createDataFrame([], MARKS)
    assert contents.parsed_contents(pages, marks).count() == 0
    assert contents.placed_contents(contents.dated_contents(pages), pages).count() == 0
