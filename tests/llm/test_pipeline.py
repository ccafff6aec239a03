import re

from pyspark.sql import functions as F

import corpus_pipeline
from folia.llm import mixing


def test_stages_end_to_end(spark, tmp_path):
    english = "the cat of the house and the dog to the garden in that small town with a red door from which one saw number {i} and more words that differ {i} times {i} over"
    french = "le chat des voisins était où la rue une porte avec ça et encore le numéro {i} qui change {i} fois dans chaque phrase {i} ici"
    rows = [(i, (english if i % 3 else french).format(i=f"n{i}x{i * 7}"), "en" if i % 3 else "fr", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[4][1], "en", "s1", 0), (101, "12345 678", "en", "s1", 0), (102, None, "en", "s1", 0), (103, "write to me at someone@corp.example.org about the garden of the house", None, "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, step in corpus_pipeline.STAGES:
        after = step(spark, docs, str(tmp_path))
        after.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    language, unique, private, mixed, tokens = seen
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in seen[:-1])
    assert {r.doc_id for r in language.collect()} == {*range(60), 100, 103}
    assert language.where("lang IS NULL").count() == 0
    assert {r.doc_id for r in unique.collect()} == {*range(60), 103}
    texts = {r.doc_id: r.text for r in private.collect()}
    assert "@" not in texts[103] and "[EMAIL]" in texts[103]
    assert all(texts[i] == rows[i][1] for i in range(60))
    times = {r.doc_id: round(r.taken / r.size) for r in mixing.op7_mixing(private).collect()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(abs(got.get(i, 0) - n) <= 1 for i, n in times.items())
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    for r in tokens.dropDuplicates(["doc_id"]).collect():
        assert list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids
    assert tokens.count() == mixed.count()
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert ran.count() == tokens.count() and re.fullmatch(r"bigint", dict(ran.dtypes)["doc_id"])
    assert ran.where(F.size("ids") == 0).count() == 0


def test_mixture_keeps_rows_without_id_and_repeated_ids(spark):
    rows = [(None if i % 3 == 0 else i, f"word number {i} of the text", "s") for i in range(300)]
    rows += [(None, "the same words again", "s")] * 200 + [(1000, f"one id of text {i} here", "s") for i in range(20)] + [(None, " ", "s"), (None, None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    got = mixed.collect()
    words = lambda found: sum(len((r[1] or "").split()) for r in found)
    for part in (lambda r: r[0] is None and r[1] and r[1].startswith("word"), lambda r: r[1] == "the same words again", lambda r: r[0] is not None and r[0] < 1000):
        assert 1.2 * words(filter(part, rows)) <= words(filter(part, got)) <= 1.8 * words(filter(part, rows))
    # rows of one id lie side by side in the shuffle, and the schedule may be in either round there
    assert {r.text for r in got if r.doc_id == 1000} == {r[1] for r in rows if r[0] == 1000}
    assert {r.text for r in got} <= {r[1] for r in rows if r[1] and r[1].strip()}
    again = mixing.mixed_documents(df.repartition(5)).where("doc_id IS NULL")
    assert sorted(r.text for r in again.collect()) == sorted(r.text for r in got if r.doc_id is None)
