import hashlib
import random

import numpy as np
import pytest

from quillstore.llm import hashes
from quillstore.llm import substring_dedup as sd


def brute(rows, window):
    first = {}
    split = [(t or "").encode().split() for _, t in rows]
    for (i, _), w in zip(rows, split, strict=True):
        if i is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s : s + window])
                first[k] = min(i, first.get(k, i))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        if i is not None:
            for s in range(len(w) - window + 1):
                if first[tuple(w[s : s + window])] < i:
                    gone.update(range(s, s + window))
        left = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120, window=50):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)] + ["é", "Wörter"]
    passages = [rng.choices(vocabulary, k=rng.randrange(window - 3, 3 * window)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(0, 4)):
            w += rng.choices(vocabulary, k=rng.randrange(0, 80))
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randrange(0, len(p) // 2)
                w += p[a : a + rng.randrange(1, len(p))]
        if rows and rng.random() < 0.2:
            w = rng.choice(rows)[1].split()
        rows.append((i, "  ".join(w) if i % 3 else "\n".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,window,fan", [(1, 50, 256), (2, 7, 3)])
def test_against_brute_force(spark, seed, window, fan, monkeypatch):
    if fan < 256:  # several rounds of small values
        for name, value in (("FAN", fan), ("PER_ROW", 256), ("PER_TASK", 4000)):
            monkeypatch.setattr(hashes, name, value)
    rows = corpus(seed, window=window)
    rows += [(None, rows[0][1]), (rows[1][0], rows[1][1]), (rows[2][0], rows[5][1]), (500, None), (501, ""), (502, "loop " * 20000), (503, "loop " * 100)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(4)
    assert sorted(map(tuple, sd.kept_texts(docs, window, digest=True).collect()), key=str) == brute(rows, window)
    whole = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in sd.kept_texts(docs, window).collect()]
    assert sorted(whole, key=str) == brute(rows, window)
    assert sd.kept_texts(docs.limit(0), window).count() == 0


def test_a_common_passage_is_sent_once_for_each_task():
    rows = [{"h": np.array([7, 7, 9], np.uint64), "id": i} for i in range(100)]
    owner = np.repeat(np.arange(100), 3)
    probes = hashes.sorted_entries(np.concatenate([r["h"] for r in rows]), owner, [hashes.small(np.tile(np.arange(3), 100)), np.zeros(300, np.uint64)], [np.arange(100, dtype=np.int64), np.zeros(100, np.int64)])
    got = sd.smallest({sd.PROBES: probes})
    assert len(got[sd.PROBES]) == 3 and set(got[sd.PROBES].of(0).tolist()) == {0} and len(got[hashes.ANSWERS]) == 297
    met = sd.met({sd.PROBES: probes, sd.BLOCKS: hashes.Entries(np.array([7], np.uint64), columns=[np.array([0]), np.array([0])])})
    assert len(met[sd.PROBES]) == 0 and len(met[hashes.ANSWERS]) == 300


@pytest.mark.parametrize("few", [200_000, 0])
def test_texts_are_named_by_their_ids_alone_where_these_differ(spark, few, monkeypatch):
    """Hashes of texts would be most of what a packed value holds; only ids with several rows have them, or all where such ids are many."""
    monkeypatch.setattr(sd, "FEW", few)
    rows = [(1, "a b"), (2, "c"), (2, "d"), (None, "e"), (3, None), (None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text): r.key for r in sd.identified(docs).collect()}
    assert got.keys() == set(rows) and got[(2, "c")] != got[(2, "d")] and 0 not in (got[(2, "c")], got[(2, "d")])
    assert all((got[k] == 0) == bool(few) for k in ((1, "a b"), (3, None)))
    rows = corpus(5, 60)
    rows += [(rows[3][0], rows[9][1]), (rows[3][0], rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, sd.kept_texts(docs, digest=True).collect()), key=str) == brute(rows, 50)
