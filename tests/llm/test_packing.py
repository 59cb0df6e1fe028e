import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillstore.llm import packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_each_once_with_little_padding(seed):
    rng = random.Random(seed)
    histogram = {n: rng.randrange(0, 40) for n in rng.sample(range(1, 512), 300)} if seed else {300: 5000}
    patterns = packing.plan(histogram)
    held = defaultdict(int)
    for p in patterns:
        assert p.times > 0 and sum(n * k for n, k in p.lengths) <= 1024
        for n, k in p.lengths:
            held[n] += k * p.times
    assert held == {n: c for n, c in histogram.items() if c}
    if seed:  # nothing wasted but in the last sequences
        tokens = sum(n * c for n, c in histogram.items())
        assert sum(p.times for p in patterns) <= tokens / 1024 + 3
    assert packing.plan({}) == [] and packing.plan({0: 7}) == []


def test_knapsack_against_brute_force():
    import itertools

    import numpy as np

    lengths, values = np.array([3, 5, 7]), np.array([0.4, 0.75, 1.0])
    best = max(sum(k * v for k, v in zip(c, values, strict=True)) for c in itertools.product(range(7), repeat=3) if (np.array(c) * lengths).sum() <= 20)
    got, pattern = packing.price(values, lengths, 20)
    assert abs(got - best) < 1e-9 and (pattern * lengths).sum() <= 20 and abs(pattern @ values - best) < 1e-9


def test_pieces(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["the", "quick", "Fox,", "né", "12"], k=rng.randrange(0, 1500))), 0) for i in range(120)]
    rows += [(500, None, 0), (501, "", 0), (None, "a b", 0), (3, rows[3][1], 0), (502, "x " * 9000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(5)
    got = packing.pack(docs, BYTE).collect()
    library = Tokenizer.from_file(BYTE)
    want = sorted((str(i), [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, _ in rows)
    crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    expect = sorted((i, a, b - a, crc(ids[a:b]), len(ids)) for i, ids in want for a, b in packing.cuts(len(ids), 1024))
    assert all(sum(b - a for a, b in packing.cuts(n, 1024)) == n for n in range(1, 3000))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expect
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs.limit(0), BYTE).count() == 0
