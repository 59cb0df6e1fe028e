"""Byte-pair encoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that ends its encoding. A token t that ends at position i is this one if it starts
the word and encodes to itself, or if the last token of the prefix before t and t are a compatible pair: their joined text encodes to
these two. So the automaton of all vocabulary entries gives the matches that end at each position, pair tests single one out, and the
back-pointers give the ids. The work is linear in the word's length, unlike that of merging step by step.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
from pyspark.sql import DataFrame

from .text import RUN, SEGMENT, Memo, at_hand, per_text, texts

#: The last symbol of a word with an end-of-word suffix, as one character of its own.
END = 0xF0000


#: Runs of printable ASCII and the letters of Latin-1, behind at most one space or line end: no normal form changes them.
COMMON = re.compile("[ \n]?[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: What the two files' patterns are for such runs.
WHITE_WORDS = re.compile("'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z\u00c0-\u00ff]+| ?[0-9]+| ?[^ \nA-Za-z\u00c0-\u00ff0-9]+|[ \n]")
BARE_WORDS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\u00c0-\u00ff]+|[0-9]|[^ \na-z\u00c0-\u00ff0-9]+")
#: The steps for which these patterns hold.
COMMON_FILES = (
    (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    ),
)


class Vocabulary:
    """Vocabulary and merges of a tokenizers file; a token's text is a string with one character for each symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        model = self.spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE files are supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.strings = model["vocab"]
        self.ids = {self.symbols(s): i for s, i in self.strings.items()}
        self.by_id = {i: s for s, i in self.ids.items()}
        self.names = {i: s for s, i in self.strings.items()} | {t["id"]: t["content"] for t in self.spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.symbols(a), self.symbols(b)] = rank
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def symbols(self, s: str) -> str:
        """A vocabulary entry with its end-of-word suffix folded into the last character."""
        if self.suffix and s.endswith(self.suffix) and len(s) > len(self.suffix):
            body = s[: -len(self.suffix)]
            return body[:-1] + chr(END + ord(body[-1]))
        return s

    def word(self, piece: str) -> str:
        """The symbols of a pre-token."""
        return piece[:-1] + chr(END + ord(piece[-1])) if self.suffix and piece else piece

    def merged(self, word: str) -> list[str]:
        """The definition: merge the pair of the lowest rank, leftmost first. Only short texts of one or two tokens come here."""
        parts = list(word)
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a << 24 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 1_500_000:
                self.pairs.clear()
            x, y = self.by_id[a], self.by_id[b]
            found = self.pairs[key] = self.merged(x + y) == [x, y]
        return found

    def itself(self, a: int) -> bool:
        found = self.whole.get(a)
        if found is None:
            found = self.whole[a] = self.merged(self.by_id[a]) == [self.by_id[a]]
        return found


class PrefixEncoder:
    """Ids of one pre-token at a time, by the last token of every prefix."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for s, i in vocabulary.ids.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()

    def ids(self, word: str) -> list[int]:
        v, pairs = self.v, self.v.pairs
        last, size = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        for end, (token, length) in self.automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = pairs.get(before << 24 | token)
                if fits is None:
                    fits = v.compatible(before, token)
                if not fits:
                    continue
            elif not v.itself(token):
                continue
            last[end], size[end] = token, length
        out, at = [], len(word)
        while at:
            if last[at] < 0:
                raise ValueError(f"the vocabulary lacks a symbol of {word!r}")
            out.append(last[at])
            at -= size[at]
        return out[::-1]


class Codec:
    """Whole texts to ids and back. The file's own normalizer and pre-tokenizer cut words; the encoder above makes their ids.

    A text is taken in runs that no pre-token and no special token crosses, so a run's ids don't depend on its neighbours. keeps_white
    tells whether pre-tokens can begin with white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.v = Vocabulary(path)
        self.encoder = PrefixEncoder(self.v)
        self.parts = Tokenizer.from_file(path)
        self.normalizer, self.pre = self.parts.normalizer, self.parts.pre_tokenizer
        self.keeps_white = self.v.spec["pre_tokenizer"]["type"] == "ByteLevel"
        self.joins = self.v.spec.get("decoder") is None
        self.run = SEGMENT if self.keeps_white else RUN
        self.plain = (self.v.spec["normalizer"], self.v.spec["pre_tokenizer"]) in COMMON_FILES
        self.shown = Memo(self.show, 250_000)
        self.word_ids = Memo(lambda w: self.encoder.ids(self.v.word(w)), 250_000)

    def pieces(self, run: str):
        """Pre-tokens of a run, or the id of a special token."""
        if COMMON.fullmatch(run) and "<|" not in run:  # the same cuts for the commonest characters, without a call for each step
            if self.plain:
                cut = WHITE_WORDS.findall(run) if self.keeps_white else BARE_WORDS.findall(run.lower())
                return [p if p.isascii() and p[0] > " " else p.encode().decode("latin-1").translate(SHOWN) for p in cut]
        return self.any_pieces(run)

    def any_pieces(self, run: str):
        for part in self.v.special_split.split(run) if self.v.special_split else [run]:
            if part in self.v.special:
                yield self.v.special[part]
            elif part:
                clean = self.normalizer.normalize_str(part) if self.normalizer else part
                yield from (p for p, _ in self.pre.pre_tokenize_str(clean) if p)

    def run_ids(self, run: str) -> list[int]:
        out = []
        for p in self.pieces(run):
            if isinstance(p, int):
                out.append(p)
            else:
                out += self.word_ids[p]
        return out

    def show(self, run: str) -> tuple[str, int, str]:
        """A run's ids as text, their number, and what they decode to."""
        ids = self.run_ids(run)
        return " ".join(map(str, ids)), len(ids), self.decode(ids)

    def encode(self, text: str | None) -> list[int]:
        return [i for run in self.run.findall(text or "") for i in self.run_ids(run)]

    def decode(self, ids: list[int]) -> str:
        """As the library: without a decoder in the file, the tokens joined by spaces; else their bytes. Unknown ids are left out."""
        names = [self.v.names[i] for i in ids if i in self.v.names]
        if self.joins:
            return " ".join(names)
        out = bytearray()
        for name in names:
            try:
                out += bytes(BYTE_OF[c] for c in name)
            except KeyError:
                out += name.encode()
        return out.decode("utf-8", "replace")


def _bytes() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


BYTE_OF = _bytes()
SHOWN = {b: c for c, b in BYTE_OF.items()}


def codec(path: str) -> Codec:
    """One for each Python worker and file."""
    return at_hand("tokens", path, Codec)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string: a text's ids and what they decode to. A null text counts as empty, an empty one has no ids."""

    def rows(text):
        c = codec(path)
        ids = c.encode(text)
        return ids, c.decode(ids)

    schema = "doc_id long, ids array<int>, decoded string"
    return texts(docs, id_col, text_col).mapInArrow(per_text(schema, rows, ["ids", "decoded"], "tokens"), schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, repeated rows included; a null doc_id stays null.

    Whole texts of any length are encoded, in time linear in it; other columns aren't read, whatever their names; an empty table gives none.

    A null text counts as empty: no tokens, both digests those of the empty string. It makes the digests run by run, so that ids never
    leave the worker, and needs no shuffle. Needs a file whose tokens decode one by one (no decoder in it); others go by encode_texts.
    """

    def rows(text):
        c = codec(path)
        if not c.joins:
            ids = c.encode(text)
            n, shown, decoded = len(ids), " ".join(map(str, ids)), c.decode(ids)
        else:
            made = list(map(c.shown.__getitem__, c.run.findall(text or "")))
            n = sum([m[1] for m in made])
            shown, decoded = " ".join([m[0] for m in made]), " ".join([m[2] for m in made])
        return n, hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts(docs, id_col, text_col).mapInArrow(per_text(schema, rows, ["n_tokens", "ids_sha256", "decoded_sha256"], "tokens"), schema)
