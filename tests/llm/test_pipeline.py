import random
import struct
import zlib

import corpus_pipeline
from tokenizers import Tokenizer

from quillstore.llm import packing, quality, toxicity
from quillstore.llm.queries import BYTE_BPE

from .test_jaccard import brute as near
from .test_substrings import brute as cut


def write(spark, folder):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = " ".join(rng.choices(vocabulary, k=70))
    docs, labels = [], []
    for i in range(160):
        w = rng.choices(vocabulary, k=rng.randrange(20, 300))
        if i % 4 == 0:
            w[3] = w[9] = "vile"
        if i % 5 == 1:
            w = [x + "###" for x in w]
        text = " ".join(w)
        if i % 7 == 2:
            text = docs[-1][1] if i % 2 else docs[-1][1] + " end"
        if i % 7 == 3:
            text += "\n" + passage
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, 1, int(" vile " in text)))
    docs += [(200, None, "en", None, None), (201, "", None, "src1", 0), (None, " ".join(rng.choices(vocabulary, k=40)), "en", "src1", 1), docs[5]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_run_against_plain_steps(spark, tmp_path):
    docs, labels = write(spark, str(tmp_path))
    model = toxicity.learn(docs, labels)
    rows = [tuple(r) for r in docs.collect() if model.score(r.text) < 0.7]
    assert 0 < len(rows) < 164
    verdict = {(r.doc_id, r.n_words, r.word_chars): r.kept for r in quality.verdicts(spark.createDataFrame(rows, docs.schema)).collect()}
    size = lambda t: (len((t or "").split()), sum(map(len, (t or "").split())))
    passed = [r for r in rows if verdict[(r[0], *size(r[1]))]]
    assert not any("###" in r[1] for r in passed) and any(r[0] is None for r in passed) and len(passed) > 50
    group = {i: c for i, _, c in near([(r[0], r[1]) for r in passed if r[0] is not None])}
    stay, seen = [], set()
    for r in passed:
        if r[0] is None or group[r[0]] == r[0] and r[0] not in seen:
            stay.append(r)
            seen.add(r[0])
    assert len(stay) < len(passed)
    gone = {r[0]: r[2] for r in cut([(r[0], r[1]) for r in stay], 50)}
    assert any(gone.values())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(BYTE_BPE)
    crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    assert {r.doc_id for r in got} == {r[0] for r in stay}
    for r in stay:
        own = sorted((p.start, p.length, p.ids_crc32) for p in got if p.doc_id == r[0])
        ids = [*library.encode(r[1], add_special_tokens=False).ids, 0]
        if not gone[r[0]]:
            assert own == [(a, b - a, crc(ids[a:b])) for a, b in packing.cuts(len(ids), 1024)]
        else:
            assert sum(n for _, n, _ in own) < len(ids)


def test_stages_pass_columns_of_any_name(spark, tmp_path):
    """Names that stages use inside, very long and odd texts, and types of columns stay as they are."""
    names = ["key", "ranges", "copy", "bad_key", "bad_id", "node", "hi", "rows", "own_key", "score"]
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(30)]
    texts[3], texts[9], texts[11] = passage + " " + texts[3], texts[9] + "\n" + passage, " ".join(f"w{rng.randrange(9000)}" for _ in range(60_000))
    rows = [(i, t, "en", "s", len(t), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    schema = "doc_id int, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [x.split()[0] for x in schema.split(", ")], name
    want = {r[0]: r for r in rows}
    short = want[9][1].replace("\n" + passage, "")
    want[9] = (9, short, "en", "s", len(short), *want[9][5:])
    assert {r.doc_id: tuple(r) for r in docs.collect()} == want


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, kind in (("documents", schema), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
