import random

import numpy as np
import pytest

from quillstore.llm import components, hashes, jaccard_join


def shingles(text):
    w = [x for x in (text or "").encode().lower().split()]
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    ids = [r[0] for r in rows]
    sets = [shingles(r[1]) for r in rows]
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) or ids[i] == ids[j]:
                x, y = root(ids[i]), root(ids[j])
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in zip(ids, sets, strict=True))


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:  # a near copy, a few words changed
            w = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randrange(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary).upper()
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 5, 8, 60, 200]))) + (" " + passage if rng.random() < 0.5 else "")))
    return rows


@pytest.mark.parametrize("seed,part,fan", [(1, 60_000, 256), (2, 300, 3)])
def test_against_brute_force(spark, seed, part, fan, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART", part)
    if fan < 256:  # several rounds of small values
        for name, value in (("FAN", fan), ("PER_ROW", 64), ("PER_TASK", 700)):
            monkeypatch.setattr(hashes, name, value)
    rows = corpus(seed)
    rows += [(rows[3][0], rows[90][1]), (rows[5][0], "only here " * 9), (1000, "only here " * 9)]  # one document of several texts
    got = jaccard_join.join(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_shingles string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, "a b c d e f", 0), (3, None, 0), (4, "", 0), (None, "a b c d e f", 0), (2, "A  b c\td e f", 0), (5, "a b c d e f", 0), (9, "solo", 0), (8, "Solo", 0), (7, "É a", 0), (6, "é a", 0), (1, "z " * 30000, 0)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string, lo int"))
    key = lambda r: str(tuple(r))
    want = [(5, 2, 2), (3, 0, 3), (4, 0, 4), (None, 2, None), (2, 2, 2), (5, 2, 2), (9, 1, 8), (8, 1, 8), (7, 1, 7), (6, 1, 6), (1, 1, 1)]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_against_all_pairs():
    rng = random.Random(4)
    for _ in range(30):
        base = rng.sample(range(10**6), 40)
        sets = []
        for _ in range(25):
            x = set(rng.sample(base, rng.randrange(30, 41))) | set(rng.sample(range(10**6), rng.randrange(0, 6)))
            sets.append(np.array(sorted(x), np.int64))
        up = list(range(25))
        root = lambda i: i if up[i] == i else root(up[i])  # noqa: B023, E731
        for a, b in jaccard_join.linked(sets, [], 80):
            up[max(root(a), root(b))] = min(root(a), root(b))
        got = [root(i) for i in range(25)]
        up = list(range(25))
        for i in range(25):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= 80 * len(a | b):
                    up[max(root(i), root(j))] = min(root(i), root(j))
        assert got == [root(i) for i in range(25)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 70), (7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 70: 50, 100: 50, 200: 200, 201: 200, 202: 200}


def test_hashes_and_packing():
    h = hashes.word_hashes([f"w{i % 9}".encode() for i in range(50)])
    for n in (1, 5, 25):
        got = hashes.window_hashes(h, n)
        same = {}
        for i, x in enumerate(got.tolist()):
            assert same.setdefault(x, tuple(h[i : i + n])) == tuple(h[i : i + n])
        assert len(got) == 51 - n and len(same) == len({tuple(h[i : i + n]) for i in range(51 - n)})
    arrays = [np.arange(10, dtype=np.uint64), np.empty(0, np.int64), np.array([3, 1], np.uint16)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, hashes.unpacked(hashes.packed(arrays)), strict=True))


@pytest.mark.parametrize("buckets,fan", [(1, 4), (4, 4), (30, 4), (1000, 3)])
def test_deal_brings_all_entries_to_their_bucket(spark, buckets, fan):
    rng = np.random.default_rng(buckets)
    deal = hashes.Deal(buckets, 64, None, fan, 16)
    assert deal.widths[-1] == 1 and all(-(-a // b) <= fan for a, b in zip([buckets, *deal.widths], deal.widths))

    def send(batches):
        for batch in batches:
            ids = np.array(batch.column("id").to_pylist(), np.int64)
            for part in np.array_split(ids, 3):
                if len(part):
                    yield deal.rows({7: hashes.sorted_entries(hashes.mixed(part.view(np.uint64)), np.arange(len(part)), [hashes.small(part)], [part])})

    def read(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        for e in hashes.received(batches).get(7, []):
            assert (np.diff(e.keys.astype(object)) >= 0).all() and (e.of(0) == e.columns[0]).all()
            yield pa.RecordBatch.from_arrays([pa.array(e.of(0)), pa.array([int(k) * buckets >> 64 for k in e.keys.tolist()], pa.int64()), pa.array([TaskContext.get().partitionId()] * len(e), pa.int64())], names=["id", "bucket", "task"])

    n = int(rng.integers(2000, 3000))
    got = deal.exchanged(spark.range(n).mapInArrow(send, hashes.SENT)).mapInArrow(read, "id long, bucket long, task long").collect()
    assert sorted(r.id for r in got) == list(range(n)) and all(r.bucket == r.task for r in got)


def test_hot_keys_are_sent_few_times():
    ids = np.arange(1000, dtype=np.int64)
    e = hashes.sorted_entries(np.full(1000, 9, np.uint64), np.arange(1000), [], [ids])
    assert len(jaccard_join.twice({0: e})[0]) == 2


def test_one_round_up_to_a_thousand_buckets():
    """6 GB of texts have some 700 buckets: a second round would send all entries once more."""
    assert hashes.Deal(700).widths == [1] and hashes.Deal(3500).widths[-1] == 1 < len(hashes.Deal(3500).widths)
    assert hashes.Deal(700).flush <= hashes.HELD and hashes.Deal(4).flush == 4 * hashes.PER_ROW


def test_part_of_the_ngrams_settles_sets(spark):
    """The count is of a third of the n-grams, never over the whole, and enough to tell that a text of its own has no link."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts + [texts[0] + " more"])), "doc_id long, text string")
    assert [jaccard_join.divisor(p) for p in (0, 50, 80, 90, 100)] == [1, 1, 3, 6, 8]
    whole, part = ({r.lo: r.lone for r in jaccard_join.lone(docs, 5, 4, every).collect()} for every in (1, 3))
    near = {hashes.digest(jaccard_join.ngrams(t, 5))[1] for t in (texts[0], texts[0] + " more")}
    assert all(part[k] <= whole[k] for k in part)
    assert all(79 < part[k] < 200 and whole[k] == 396 for k in whole if k not in near) and all(part.get(k, 0) <= 1 for k in near)


def test_sets_short_of_common_ngrams_stay_out_of_the_trie():
    """Versions of a text that all differ by more than a link allows: none is compared, and a link beside them is found."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 400)
    versions = [np.unique(np.concatenate([base[rng.random(400) < 0.86], rng.integers(0, 1 << 62, 90)])) for _ in range(40)]
    assert jaccard_join.shared(versions, [], 80) == [] == jaccard_join.shared(versions[:20], versions[20:], 80)
    close = np.append(versions[7][:-3], 1 << 62)
    assert [i for i, _ in jaccard_join.shared([*versions, close], [], 80)] == [7, 40] and jaccard_join.linked([*versions, close], [], 80) == [(40, 7)]
    assert jaccard_join.linked(versions, [close], 80) == [(40, 7)]
