import random
from collections import Counter

import corpus_pipeline as p
from lodestone.llm.near import near_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, lang_pred string"
WORDS = {"en": "the and of that with this house river stone about", "de": "der und nicht ein haus fluss stein durch über schon"}


def corpus(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        text = " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", "s", "en"]) for _ in range(rng.randrange(30, 90)))
        if i % 10 == 0:
            text += " mail a@b.com now"
        rows.append((i, text, lang if i % 5 else None, f"s{i % 4}", len(text), "x", "y"))
    rows += [(500, rows[3][1], "en", "s1", 1, "x", "y"), (501, None, "en", None, None, "x", "y"), (502, "12 34", "en", "s0", 5, "x", "y"), (None, rows[4][1] + " the end", "en", None, 3, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_each_stage_does_its_part(spark):
    docs = corpus(spark)
    columns = list(p.COLUMNS)
    first = p.identify_language(spark, docs, "")
    assert first.columns == columns
    got = {r.doc_id: r for r in first.collect()}
    assert set(range(120)) | {500, None} == set(got)
    assert all(got[i].lang == ("en" if i % 3 else "de") for i in range(120))
    second = p.drop_near_duplicates(spark, first, "")
    assert second.columns == columns
    ids = {r.doc_id for r in second.collect()}
    assert 500 not in ids and 3 in ids and 4 in ids and len(ids) >= 115
    assert near_groups(second.withColumnRenamed("n_chars", "row")).count() == second.count()
    third = p.redact(spark, second, "")
    assert third.columns == columns
    for r in third.collect():
        assert "@" not in r.text
        if r.doc_id is not None and r.doc_id % 10 == 0:
            assert r.text.endswith("mail [EMAIL] now") and r.n_chars == len(r.text)
    fourth = p.mix_sources(spark, third, "")
    assert fourth.columns == columns
    assert max(Counter(r.doc_id for r in fourth.collect()).values()) <= 3
    last = p.pack_sequences(spark, fourth, "").collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in fourth.collect()}


def test_run_and_empty_table(spark, tmp_path):
    docs = corpus(spark)
    docs.drop("row", "lang_pred").write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() > 100
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0


def test_rows_equal_in_id_and_text_are_one(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "b", 2), (None, text, "en", None, 3), (2, "something else entirely " * 9, "en", "a", 4), (2, "another text with the same id " * 9, "en", "a", 5)]
    got = p.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), "")
    assert sorted((r.doc_id, r.text.split()[0]) for r in got.collect()) == [(1, "word0"), (2, "another"), (2, "something")]


def test_near_duplicates_by_fingerprints(spark):
    """Texts that mostly repeat one phrase: equal fingerprints, but their sets of shingles are far apart."""
    phrase = " ".join(f"word{i}" for i in range(9))
    texts = [(2, " ".join([phrase] * 200)), (1, " ".join([*[phrase] * 200, *(f"other{i}" for i in range(30))])), (3, " ".join(f"else{i}" for i in range(60)))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    assert near_groups(docs.selectExpr("doc_id as row", "doc_id", "text")).select("group").distinct().count() == 3
    assert sorted(r.doc_id for r in p.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]
