import math
import random
import zlib

import numpy as np
import pytest

from quillstore.llm import toxicity


def made(spark, n=400):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(20, 200))
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vile", "nasty", "foulest", "foulers"])
        docs.append((i, " ".join(words), 0.5))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i for i in range(n) if i % 5 == 0}


def test_held_out_accuracy_and_columns(spark):
    docs, labels, bad = made(spark)
    got = toxicity.scores(docs, labels, toxicity.Options(sample=300)).collect()
    assert len(got) == 400
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id in bad) for r in held) >= 0.97 * len(held)


def test_unseen_words_lean_on_their_stem(spark):
    docs, labels, _ = made(spark)
    model = toxicity.learn(docs, labels)
    assert model.score("w1 w2 foulex w3") > model.score("w1 w2 zebra w3")
    assert model.ratios(["zebra"]).tolist() == [0.0] and model.measures("")[0] == 0


def brute(rows, options):
    """Log-likelihood ratios by word and stem of (text, toxic), counted one by one."""
    follows, with_stem, words = {}, {}, set()
    for text, y in rows:
        w = toxicity.WORD.findall(text.lower())
        for a, b in zip(["", *w], w):
            follows.setdefault((b, y), set()).add(a)
        for z in {x[: options.stem] for x in w}:
            with_stem[z, y] = with_stem.get((z, y), 0) + 1
        words |= set(w)
    d, back = options.discount, options.backoff
    stems = {w[: options.stem] for w in words}
    in_stem = {z: sum(w[: options.stem] == z for w in words) for z in stems}
    n = lambda w, y: max(len(follows.get((w, y), ())) - d, 0)
    t = lambda z, y: max(with_stem.get((z, y), 0) - d, 0)
    p_stem = lambda z, y: (1 - back) * t(z, y) / sum(t(x, y) for x in stems) + back * in_stem[z] / len(words)
    p = lambda w, y: (1 - back) * n(w, y) / sum(n(x, y) for x in words) + back * p_stem(w[: options.stem], y) / in_stem[w[: options.stem]]
    assert all(abs(sum(p(w, y) for w in words) - 1) < 1e-9 for y in (0, 1))
    return {w: math.log(p(w, 1) / p(w, 0)) for w in words}, {z: math.log(p_stem(z, 1) / p_stem(z, 0)) for z in stems}


def test_model_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["a", "bb", "abcdef", "abcdeg", "x1", "É", "zz"], k=rng.randrange(1, 9))), int(i % 3 == 0)) for i in range(30)]
    options = toxicity.Options()
    frame = spark.createDataFrame([(t, y, i % 2) for i, t, y in rows], "text string, toxic int, fold int").repartition(3)
    for k, model in enumerate(toxicity.models(frame, options)):
        words, stems = brute([(t, y) for i, t, y in rows if k == 0 or i % 2 != k - 1], options)
        assert model.ratios(list(words)) == pytest.approx(list(words.values()), abs=1e-5)
        got, known = model.stems.get(toxicity.hashed(list(stems)))
        assert known.all() and got == pytest.approx(list(stems.values()), abs=1e-5)


def test_many_weak_words_make_a_text_toxic(spark):
    """Toxic texts differ from ordinary ones only in how often they have words that both have."""
    rng = random.Random(9)
    plain, weak = [f"w{i}" for i in range(200)], [f"soft{i}x" for i in range(60)]
    weak = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for i, w in enumerate(weak)]
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = rng.choices(plain, k=60) + [w for w in weak if rng.random() < (0.4 if bad else 0.1)]
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    assert model.words.ratios.max() < 3
    held = [r for r in toxicity.scores(docs, labels).collect() if r.held_out]
    bad = [r for r in held if r.doc_id % 4 == 0]
    assert sum(r.predicted for r in bad) >= 0.8 * len(bad) and sum(r.predicted for r in held if r.doc_id % 4) <= 0.03 * len(held)


def test_means_are_divided_by_length():
    model = toxicity.Model(toxicity.Table.of(["a", "b", "c"], np.array([1.0, 2.0, -1.0])), toxicity.Table.of(["ddddd"], np.array([-0.5])))
    got = model.measures("A b c c dddddd")
    assert got[0] == pytest.approx((1 + 2 - 1 - 1 - 0.5) / 5) and got[1:4] == pytest.approx([2, 3 / 2, 1.5 / 4]) and got[-1] == pytest.approx(math.log(6))
    assert model.measures(None) == [0.0] * 8


def test_labels_elsewhere_change_nothing(spark):
    docs, labels, _ = made(spark)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    other = labels.replace({0: 1}, subset=["toxic"]).where(labels["doc_id"].isin(held)).unionByName(labels.where(~labels["doc_id"].isin(held)))
    a, b = ({(r.doc_id, r.score) for r in toxicity.scores(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_nulls_and_empty_tables(spark):
    docs, labels, _ = made(spark, 50)
    odd = docs.unionByName(spark.createDataFrame([(1000, None, 1.0), (None, "vile", 1.0), (1001, "", 1.0), (0, "vile vile", 1.0), (1002, "w1 " * 50000, 0.0)], docs.schema))
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1000, None, None), (0, 0, 0)], labels.schema))
    got = toxicity.scores(odd, more).collect()
    assert len(got) == 55 and all(r.score is not None for r in got)
    assert toxicity.scores(docs.limit(0), labels).count() == 0
    assert [r.predicted for r in toxicity.scores(docs, labels.limit(0)).limit(3).collect()] == [0, 0, 0]
