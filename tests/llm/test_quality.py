import random

import duckdb

from quillstore.llm import quality


def corpus():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "Straße", "#tag", "a|b"]
    rows = []
    for i in range(260):
        w = rng.choices(vocabulary, k=rng.choice([0, 3, 9, 10, 40, 120]))
        if i % 11 == 0:
            w = [x + "***" for x in w]
        if i % 13 == 0 and len(w) > 20:
            w += w[:12]
        lines = "\n".join(" ".join(w[j : j + 7]) for j in range(0, len(w), 7))
        if i % 17 == 0:
            lines += "\n" + "same line here\n" * 6 + "\t\n"
        rows.append((i, lines, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 1))
    return rows + [(900, None, "en", "a", 1), (901, "", None, None, 1), (None, rows[5][1], "en", "a", 1), rows[5], (902, "long " * 30000, "xx", "z", 1), (903, "a b c d e f g h i j\x0bk\x1cl m", "en", "a", 1)]


def test_against_sql(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int").repartition(4)
    got = quality.verdicts(docs)
    names = sorted(got.columns)
    c = duckdb.connect()
    c.execute("create table documents(doc_id bigint, text varchar, lang varchar, source varchar)")
    # the SQL joins by doc_id, so rows that share one, or have none, are left to the other test
    c.executemany("insert into documents values (?, ?, ?, ?)", [r[:4] for r in rows if r[0] not in (None, 5)])
    plain = quality.verdicts(docs.where("doc_id is not null and doc_id <> 5"))
    want = c.execute(f"select {', '.join(names)} from ({quality.ORACLE})").fetchall()
    assert sorted(tuple(r[n] for n in names) for r in plain.collect()) == sorted(want)
    assert {r.kept for r in got.collect()} == {True, False}


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    got = quality.verdicts(docs).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 5 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    assert all(r.base_failed and not r.kept for r in got if r.n_words == 0)
    good = quality.good(docs).collect()
    assert len(good) == sum(r.kept for r in got) and good[0].__fields__ == docs.columns
    assert quality.verdicts(docs.limit(0)).count() == 0


def test_clean_documents_stay_whatever_the_group(spark):
    """Adaptive limits never fall below the margins: a group of clean texts loses none."""
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(80)), "en", f"s{i % 3}") for i in range(300)], "doc_id long, text string, lang string, source string")
    assert quality.verdicts(docs).where("not kept").count() == 0


def test_plan_is_native(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, kept int")
    plan = quality.features(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
