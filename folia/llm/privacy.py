"""Personal data: base patterns, and terms that disclose them by corpus co-occurrence.

Everything here is DataFrame and SQL functions. A term that shares texts with an entity (an address, a
number) discloses it as far as it makes the entity likely: with information content IC(e) = -ln p(e),
disclosure is PMI(t; e) / IC(e) = 1 + ln p(e | t) / IC(e), which is 1 for a term that is seen with e only.
All counts are numbers of different texts of the corpus. Terms over one threshold are generalised, over a
higher one removed, wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm.common import scope, stage

KINDS = ("email", "ip", "card", "phone", "term")
#: A term: letters in a row.
TERM = r"\p{L}+"
#: Different texts in which a term must stand with an entity before its disclosure is estimated.
SUPPORT = 3
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Spans of a text whose lengths are summed at a time to find where they start.
BLOCK = 64

# A mail's local part starts where a run of its characters starts or the last match ended; what else
# would match lies inside such a run. Possessive loops never give back what they took.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+(?<=[0-9])"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _starts(parts: str, matches: str) -> str:
    """SQL for (start, match) of each match, from the parts between matches; linear but for sums over blocks."""
    lengths = f"zip_with({parts}, {matches}, (x, y) -> length(x) + coalesce(length(y), 0))"
    blocks = f"sequence(0, (size({matches}) - 1) div {BLOCK})"
    return f"""
      transform(array(struct({lengths} AS l)), z ->
        transform(array(transform({blocks}, b -> aggregate(slice(z.l, b * {BLOCK} + 1, {BLOCK}), 0, (s, x) -> s + x))), sums ->
          transform(array(transform({blocks}, b -> aggregate(slice(sums, 1, b), 0, (s, x) -> s + x))), before ->
            transform({matches}, (m, i) -> struct(
              before[i div {BLOCK}] + aggregate(slice(z.l, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK}), 0, (s, x) -> s + x) + length({parts}[i]) AS start,
              m AS found)))[0])[0])[0]"""


def _luhn() -> str:
    digit = "cast(substring(d, length(d) - i + 1, 1) AS INT)"
    return f"""exists(array(regexp_replace(x.found, '[^0-9]', '')), d -> length(d) BETWEEN 12 AND 19 AND
      aggregate(transform(sequence(1, length(d)), i -> if(i % 2 = 0, {digit} * 2 - if({digit} > 4, 9, 0), {digit})), 0, (s, v) -> s + v) % 10 = 0)"""


_VALID = (
    "true",
    f"x.found rlike '^{_PART}(?:[.]{_PART}){{3}}$'",
    _luhn(),
    "length(regexp_replace(x.found, '[^0-9]', '')) BETWEEN 9 AND 15",
)


def _gates(text: Column) -> tuple[Column, ...]:
    return text.contains("@"), text.rlike(r"[0-9]\.[0-9]"), text.rlike("[0-9](?:[ -]?[0-9]){11}"), text.contains("+")


def with_base_spans(docs: DataFrame) -> DataFrame:
    """Adds base: array of (start, kind, end) of the base patterns, by start, then kind (null text: empty)."""
    columns = [c for c in docs.columns if c != "base"]
    text, out = F.col("__text"), docs.withColumn("__text", F.coalesce("text", F.lit("")))
    empty = F.array().cast("array<string>")
    for k, (pattern, gate) in enumerate(zip((_EMAIL, _IP, _CARD, _PHONE), _gates(text), strict=True)):
        out = out.withColumn(f"__m{k}", F.when(gate, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(empty))
        out = out.withColumn(f"__p{k}", F.when(F.size(f"__m{k}") > 0, F.split(text, pattern, -1)))
    for k, valid in enumerate(_VALID):
        spans = f"filter({_starts(f'__p{k}', f'__m{k}')}, x -> {valid})"
        none = "cast(array() AS array<struct<start:int,kind:int,end:int>>)"
        out = out.withColumn(f"__s{k}", F.expr(f"if(size(__m{k}) > 0, transform({spans}, x -> struct(x.start AS start, {k} AS kind, x.start + length(x.found) AS end)), {none})"))
    return out.select(*columns, F.expr("array_sort(concat(__s0, __s1, __s2, __s3))").alias("base"))


#: Addresses are matched too, so that their parts are no terms.
_TERM_OR_EMAIL = f"(?:{_EMAIL})|{TERM}"


def _terms() -> Column:
    """The different terms of text, in lower case."""
    text = F.col("text")
    masked = F.filter(F.regexp_extract_all(text, F.lit(_TERM_OR_EMAIL), 0), lambda x: ~x.contains("@"))
    found = F.when(text.contains("@"), masked).otherwise(F.regexp_extract_all(text, F.lit(TERM), 0))
    return F.array_distinct(F.transform(found, F.lower))


def _text_id(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def disclosing_terms(texts: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(entity, term, disclosure) of the terms that disclose an entity at least so far.

    texts: one row per different text, with text_id, text and base. p(e | t) is the share of the texts
    with t that hold e too. Pairs that can't reach the disclosure are left out before they are counted: a
    term in more than alone / p(e) ** (1 - least) texts stands mostly without e, whatever they share.
    """
    total = texts.count()
    found = "substring(text, x.start + 1, x.end - x.start)"
    names = f"transform(base, x -> CASE x.kind WHEN 0 THEN lower({found}) WHEN 1 THEN {found} ELSE regexp_replace({found}, '[^0-9]', '') END)"
    held = stage(texts.where("size(base) > 0").select("text_id", F.explode(F.array_distinct(F.expr(names))).alias("entity")), "privacy-entities")
    alone = held.groupBy("entity").agg(F.count("*").alias("alone")).where(f"alone >= {support}")
    most = F.expr(f"alone / power(alone / {total}D, {1 - least}D) * 1.000001D")
    known = stage(held.join(alone, "entity").withColumn("most", most), "privacy-known")
    words = texts.select("text_id", F.explode(_terms()).alias("term"))
    frequency = stage(words.groupBy("term").agg(F.count("*").alias("documents")).where(f"documents >= {support}"), "privacy-terms")
    bounds = known.groupBy("text_id").agg(F.max("most").alias("most"))
    near = texts.join(bounds, "text_id").select("text_id", "most", F.explode(_terms()).alias("term"))
    near = near.join(frequency, "term").where("documents <= most").select("text_id", "term", "documents")
    pairs = near.join(known, "text_id").where("documents <= most").groupBy("entity", "term", "alone", "documents").agg(F.count("*").alias("together"))
    disclosure = F.expr(f"1 + ln(together / documents) / nullif(-ln(alone / {total}D), 0D)")
    return pairs.where(f"together >= {support}").select("entity", "term", disclosure.alias("disclosure")).where(f"disclosure >= {least}")


def _marked(texts: DataFrame, risky: DataFrame) -> DataFrame:
    """(text_id, terms): where the risky terms stand in all texts, with the most that each discloses."""
    worst = stage(risky.groupBy("term").agg(F.max("disclosure").alias("disclosure")), "privacy-risky")
    where = texts.select("text_id", F.explode(_terms()).alias("term")).join(worst, "term", "left_semi").select("text_id").distinct()
    words = texts.join(where, "text_id", "left_semi")
    words = words.select("text_id", F.regexp_extract_all("text", F.lit(_TERM_OR_EMAIL), 0).alias("m"), F.split("text", _TERM_OR_EMAIL, -1).alias("p"))
    words = words.select("text_id", F.explode(F.expr(_starts("p", "m"))).alias("x"))
    words = words.select("text_id", F.col("x.start").alias("start"), F.expr("x.start + length(x.found)").alias("end"), F.lower("x.found").alias("term"))
    spans = F.array_sort(F.collect_list(F.struct("start", "end", "disclosure")))
    return words.join(worst, "term").groupBy("text_id").agg(spans.alias("terms"))


def text_spans(docs: DataFrame) -> DataFrame:
    """(text_id, base, terms), one row per different text of docs (null text: empty).

    base: array of (start, kind, end) of the patterns; terms: array of (start, end, disclosure) of the
    terms that disclose an entity of the corpus, outside base spans. Copies are put together before texts
    are moved, so a text that a third of all rows hold is one row of each task.
    """
    texts = docs.select(_text_id(F.col("text")).alias("text_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.groupBy("text_id").agg(F.first("text").alias("text"))
    with scope() as kept:
        texts = stage(with_base_spans(texts), "privacy-texts")
        terms = _marked(texts, disclosing_terms(texts))
        none = F.array().cast("array<struct<start:int,end:int,disclosure:double>>")
        outside = F.expr("filter(terms, t -> NOT exists(base, b -> t.start < b.end AND b.start < t.end))")
        spans = texts.drop("text").join(terms, "text_id", "left").select("text_id", "base", F.coalesce(outside, none).alias("terms"))
        return kept(stage(spans, "privacy-spans"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text_id, base and terms, as text_spans() gives them.

    Texts are read whole, rows of the same text have the same result, and other columns are not read.
    """
    return docs.select("doc_id", _text_id(F.col("text")).alias("text_id")).join(text_spans(docs), "text_id").select("doc_id", "text_id", "base", "terms")


def _joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')"


_ALL = "array_sort(concat(base, transform(terms, t -> struct(t.start AS start, 4 AS kind, t.end AS end))))"


def op4_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every document."""
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) AS BIGINT)").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return find_personal_data(docs).select(
        "doc_id", *counts, F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined(_ALL)).alias("spans"), F.expr("cast(size(terms) AS BIGINT)").alias("n_term")
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data out of text, and n_chars (where there is one) brought up to date.

    Base spans become their kind in capitals and brackets; disclosing terms become [TERM], or go where
    they disclose nearly all. Of overlapping spans the first counts, and the longest of those that start
    together. Texts without spans stay as they are, null included.
    """
    names = docs.columns
    found = text_spans(docs).where("size(base) > 0 OR size(terms) > 0")
    labels = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS[:4]) + ")"
    spans = f"""
      array_sort(concat(
        transform(base, x -> struct(x.start AS start, -x.end AS until, {labels}[x.kind] AS label)),
        transform(terms, t -> struct(t.start AS start, -t.end AS until, if(t.disclosure >= {REMOVE}, '', '[TERM]') AS label))))"""
    # the row as one column: names of its own clash with nothing
    rows = docs.select(F.struct("*").alias("doc"), "text", _text_id(F.col("text")).alias("text_id")).join(found.select("text_id", F.expr(spans).alias("spans")), "text_id", "left")
    cleaned = """
      aggregate(spans, struct(0 AS at, '' AS done),
        (s, x) -> if(x.start < s.at, s, struct(-x.until AS at, concat(s.done, substring(text, s.at + 1, x.start - s.at), x.label) AS done)),
        s -> concat(s.done, substring(text, s.at + 1)))"""
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.expr(cleaned))
    rows = rows.select("doc", "spans", clean.alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("doc.n_chars")).otherwise(F.length("clean").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in names])
