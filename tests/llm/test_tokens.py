import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillstore.llm import bpe, token_count

WORD, BYTE = (public_tokenizers.path(f"{x}.json") for x in ("word_bpe_49k", "byte_bpe_50k"))
ODD = ["", "  ", "a", "Héllo  wörld\t\n x", "<|endoftext|> a <|startoftext|>B<|ENDOFTEXT|>", "a\x1cb \x85c​d᠎e　f", "don't DON'T we'll 123 ４５ ½", "é ́x ΑΣ ΣΑΣ İstanbul", "a" * 3000, "日本語テキスト 🎉👩‍👩", "\x00\x01  z", "''s 's'", "x <|endoftext|>", "x  <|endoftext|>  y", "trail  \n ", "=" * 500]


def texts():
    rng = random.Random(3)
    alphabet = "abcdefgh the in ing  \n\t.,!'s<|>éßøĀ́ 日x1２"
    return ODD + ["".join(rng.choices(alphabet, k=rng.randrange(1, 200))) for _ in range(300)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_codec_is_exact(path):
    library, own = Tokenizer.from_file(path), bpe.codec(path)
    for x in texts():
        ids = library.encode(x, add_special_tokens=False).ids
        assert own.encode(x) == ids, x
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_white_space_and_every_character():
    library, own = Tokenizer.from_file(BYTE), bpe.codec(BYTE)
    for i in [*range(0x20, 0x600), *range(0x1680, 0x1690), *range(0x2000, 0x2070), *range(0x3000, 0x3010), 0xFEFF]:
        x = f"ab{chr(i)}cd {chr(i)}{chr(i)} x{chr(i)} "
        assert own.encode(x) == library.encode(x, add_special_tokens=False).ids, i


def test_counts_by_any_chunk():
    library, own = Tokenizer.from_file(BYTE), token_count.counter(BYTE)
    for x in texts():
        n = len(library.encode(x, add_special_tokens=False).ids)
        for chunk in (1, 2, 7, 64, 1 << 16):
            if chunk > 2 or len(x) < 400:
                assert own.total(x, chunk) == n, (chunk, x)


def test_unbroken_texts_by_any_chunk():
    """Runs of one class longer than any chunk, class changes, contractions and special strings at the edges of chunks."""
    library, own, rng = Tokenizer.from_file(BYTE), token_count.counter(BYTE), random.Random(11)
    parts = ["a" * 90, "abcxyz" * 30, "漢字仮名" * 40, "1234567890" * 12, "'" * 200, "'s", "'re", "'", " " * 100, "\n" * 80, "\t \n", "!?=-" * 30, "x1", "<|endoftext|>", "<|endof", "é" * 70, " ", "'ll" * 30, "\x1c", "_" * 70]
    for _ in range(120):
        x = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        n = len(library.encode(x, add_special_tokens=False).ids)
        for chunk in (3, 17, 100, 1 << 16):
            assert own.total(x, chunk) == n, (chunk, x)


def test_unbroken_text_takes_memory_of_its_size():
    own, x = token_count.counter(BYTE), "".join(random.Random(2).choices("abcdefgh", k=1 << 20))
    own.total(x[: 1 << 17])
    tracemalloc.start()
    n = own.total(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(Tokenizer.from_file(BYTE).encode(x, add_special_tokens=False).ids) and peak < 16 * len(x) + (64 << 20)


def test_full_table_starts_anew():
    small = token_count.Transducer(bpe.codec(BYTE), limit=5)
    whole = token_count.Transducer(bpe.codec(BYTE))
    for w in ("thanks", "thinking", "zzzz", "thanks"):
        assert small.count(w) == whole.count(w) == len(bpe.codec(BYTE).encoder.ids(w))


def test_queries_rows(spark):
    rows = [(1, "Hello there", 9), (2, None, 9), (3, "", 9), (None, "x" * 20000, 9), (1, "Hello there", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    library = Tokenizer.from_file(WORD)
    for r, (i, text, _) in zip(bpe.digests(docs, WORD).collect(), rows, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert tuple(r) == (i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    library = Tokenizer.from_file(BYTE)
    for r, (i, text, _) in zip(token_count.token_counts(docs, BYTE).collect(), rows, strict=True):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert tuple(r) == (i, len(text or ""), n, n > 512)
    full = bpe.encode_texts(docs, BYTE).collect()
    assert full[0].decoded == "Hello there" and full[1].ids == [] and len(full) == 5
    assert bpe.digests(docs.limit(0), WORD).count() == 0
