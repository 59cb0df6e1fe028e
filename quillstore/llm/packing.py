"""Packing by cutting-stock column generation.

A document's ids are cut into full sequences, at most one half, and a remainder shorter than that. Halves go two to a sequence. Remainders of equal length are alike, so the histogram of their lengths,
fewer than 512 numbers, is all that the driver needs: a linear program over patterns (how many remainders of which length share a
sequence), whose columns a knapsack dynamic program prices, gives how often to use each pattern. Rounded down, with the rest filled
greedily, the patterns are dealt to the documents by their rank among those of equal remainder; ranks come from counts by task, so no
task ever sees a whole class.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WHITE, at_hand, kept, slices, texts, trimmed

SIZE = 1024
#: How near to the least possible number of shared sequences the linear program's solution is.
GAP = 0.0005
#: Longer texts are tokenized in parts of about so many characters.
GROUP = 1 << 20


#: The pre-tokens of byte-level files.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space or of other characters that are left to the library whose work doesn't grow with the square of their length.
UNBROKEN = re.compile(f"[^{WHITE}]{{1000}}|[{WHITE}]{{1000}}")


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in byte-level files: itself if it can be shown, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class IdBytes:
    """A text's ids as little-endian 32-bit integers.

    Where the file is a byte-level BPE whose ids rise with the order of its merges, tiktoken gives the same ids in a fraction of the time;
    other files, and texts with a run of a thousand characters of one kind, white or not, go through tokenizers.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.quick = self.ranked(json.load(f))

    @staticmethod
    def ranked(spec: dict):
        """A tiktoken encoding with the file's vocabulary; None if the file isn't of the kind."""
        import tiktoken

        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = model.get("type") == "BPE" and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            return None
        special = {t["content"]: t["id"] for t in added}
        own = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(own, own[1:])):
            return None
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("file", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) > GROUP:
            return b"".join(self.part(x) for x in slices(text, GROUP))
        return self.part(text)

    def part(self, text: str) -> bytes:
        if self.quick is None or UNBROKEN.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.quick.encode(text, allowed_special="all")
        return array("I", ids).tobytes()


def id_bytes(path: str) -> IdBytes:
    return at_hand("ids", path, IdBytes)


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """Where n ids are cut: full sequences, a half if there is one, the remainder."""
    edges = [*range(0, n + 1, size)]
    if n - edges[-1] >= size // 2:
        edges.append(edges[-1] + size // 2)
    if edges[-1] < n:
        edges.append(n)
    return list(zip(edges, edges[1:]))


def measure(docs: DataFrame, path: str, end_id: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """For each row: doc_id, doc_tokens, crcs of its pieces, remainder; and its place in the task: part, the numbers of earlier full pieces and halves, the rank among its remainder."""

    def run(batches):
        path_ids, part, full, halves, seen = id_bytes(path), TaskContext.get().partitionId(), 0, 0, [0] * (size // 2)
        end = struct.pack("<I", end_id)
        for batch in batches:
            ids, made = batch.column("doc_id").to_pylist(), []
            for text in batch.column("text").to_pylist():
                data = memoryview(path_ids(text) + end)
                n = len(data) // 4
                rest, half = n % (size // 2), n % size >= size // 2
                made.append((n, [zlib.crc32(data[4 * a : 4 * b]) for a, b in cuts(n, size)], rest, part, full, halves, seen[rest]))
                full += n // size
                halves += half
                seen[rest] += 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=["doc_id", "doc_tokens", "crcs", "rest", "part", "full_before", "halves_before", "rank_in_part"])

    return texts(docs, id_col, text_col).mapInArrow(trimmed(run, "ids"), "doc_id long, doc_tokens long, crcs array<long>, rest int, part int, full_before long, halves_before long, rank_in_part long")


@dataclass
class Pattern:
    """Remainders that share a sequence: (length, number) by falling length, and how many sequences."""

    lengths: tuple[tuple[int, int], ...]
    times: int


def price(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of the highest value within size, and that value."""
    best, taken = np.zeros(size + 1), np.full(size + 1, -1)
    for room in range(1, size + 1):
        fits = int(np.searchsorted(lengths, room, "right"))
        best[room] = best[room - 1]
        if fits:
            worth = best[room - lengths[:fits]] + values[:fits]
            k = int(worth.argmax())
            if worth[k] > best[room] + 1e-12:
                best[room], taken[room] = worth[k], k
    pattern, room = np.zeros(len(lengths)), size
    while room:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= lengths[taken[room]]
    return float(best[size]), pattern


def first_basis(lengths: np.ndarray, demand: np.ndarray, size: int) -> list[tuple[int, np.ndarray, float]]:
    """Patterns, each with a length it uses up and how often it is used: the longest that is left with what fills its sequence best, until one of them runs out.

    No later pattern has that length, so the columns are independent: a feasible basis, already nearly full.
    """
    left, open_, out = demand.copy(), np.ones(len(lengths), bool), []
    while open_.any():
        own = np.flatnonzero(open_)
        column = np.zeros(len(lengths))
        column[own] = price(lengths[own] * (1 + lengths[own] / size**2), lengths[own], size - int(lengths[own[-1]]))[1]
        column[own[-1]] += 1
        often = np.where(column > 0, left / np.where(column > 0, column, 1), np.inf)
        ends = int(often.argmin())
        out.append((ends, column, max(float(often[ends]), 0.0)))
        left = np.maximum(left - column * out[-1][2], 0)
        open_[ends] = False
    return out


def relaxed(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float) -> list[tuple[np.ndarray, float]]:
    """The linear program's patterns and how often each is used, by the revised simplex method, proven to be within `gap` of the least possible.

    No solution can need less than the tokens take, nor less than the duals' worth of the demand over the best pattern's worth. Columns are
    priced until one of both bounds is that near, or none prices in. Sums of products, not matrix calls: the latter can hang in a driver
    that has forked.
    """
    m = len(lengths)
    inverse, basis, use = np.eye(m), [np.zeros(m)] * m, np.zeros(m)

    def enter(column: np.ndarray, move: np.ndarray, out: int) -> None:
        row = inverse[out] / move[out]
        np.subtract(inverse, np.multiply.outer(move, row), out=inverse)
        inverse[out], basis[out] = row, column

    for out, column, often in reversed(first_basis(lengths, demand, size)):
        enter(column, (inverse * column).sum(axis=1), out)
        use[out] = often
    least = float((lengths * demand).sum()) / size
    while use.sum() > (1 + gap) * least:
        duals = inverse.sum(axis=0)
        value, column = price(duals, lengths, size)
        least = max(least, float((duals * demand).sum()) / max(value, 1.0))
        if value <= 1 + 1e-7:
            break
        move = (inverse * column).sum(axis=1)
        can = move > 1e-9
        if not can.any():
            break
        out = int(np.where(can, use / np.where(can, move, 1), np.inf).argmin())
        gain = use[out] / move[out]
        use = np.maximum(use - move * gain, 0)
        use[out] = gain
        enter(column, move, out)
    return list(zip(basis, use, strict=True))


def plan(histogram: dict[int, int], size: int = SIZE, gap: float = GAP) -> list[Pattern]:
    """Patterns that hold each remainder of the histogram exactly once."""
    left = {n: c for n, c in sorted(histogram.items()) if n and c}
    out = []

    def use(own: list[tuple[int, int]], most: int) -> None:
        times = min([most, *(left[n] // k for n, k in own)])
        if times > 0:
            out.append(Pattern(tuple(own), times))
            for n, k in own:
                left[n] -= k * times

    if left:
        lengths = np.array(list(left))
        for column, often in sorted(relaxed(lengths, np.array(list(left.values()), float), size, gap), key=lambda x: (-x[1], x[0].tolist())):
            use([(int(n), int(k)) for n, k in zip(lengths[::-1], column[::-1], strict=True) if k], int(often + 1e-9))
    # what rounding left over: the longest, and what fills the rest best; a pattern that asks for more than there is takes what there is
    while left := {n: c for n, c in left.items() if c}:
        longest = max(left)
        lengths = np.array(list(left))
        _, column = price(lengths * (1 + lengths / size**2), lengths, size - longest)
        own, room = {longest: 1}, size - longest
        for n, k in zip(lengths[::-1].tolist(), column[::-1].tolist(), strict=True):
            if k := min(int(k), left[n] - own.get(n, 0)):
                own[n] = own.get(n, 0) + k
                room -= n * k
        for n in sorted(left, reverse=True):
            if k := min(left[n] - own.get(n, 0), room // n):
                own[n] = own.get(n, 0) + k
                room -= n * k
        use(sorted(own.items(), reverse=True), size * max(left.values()))
    return out


def dealt(patterns: list[Pattern], size: int = SIZE) -> dict[int, np.ndarray]:
    """For each length, by rank: first rank, number in a sequence, first sequence, first offset in the sequence."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks, sequence = dict.fromkeys(range(size), 0), 0
    for p in patterns:
        offset = 0
        for n, k in p.lengths:
            table.setdefault(n, []).append((ranks[n], k, sequence, offset))
            ranks[n] += k * p.times
            offset += n * k
        sequence += p.times
    return {n: np.array(rows, np.int64) for n, rows in table.items()}


def pack(docs: DataFrame, path: str, end_id: int = 0, size: int = SIZE, gap: float = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of each row.

    A null or empty text has only the end id; repeated rows are packed each by itself; a null doc_id stays null; an empty table gives no
    pieces; other columns aren't read. Of remainders of equal length, the earlier in the order of tasks and rows comes first. Texts of any length are cut. Sequence ids count up from 0: first the
    sequences that remainders share, then those of two halves, then the full ones. Only the histogram, of fewer than `size` numbers, and the patterns made of it are on the driver.
    """
    found = kept(measure(docs, path, end_id, size, id_col, text_col))
    half = size // 2
    counts = found.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.expr(f"doc_tokens div {size}")).alias("full"), F.sum(F.expr(f"doc_tokens % {size} div {half}")).alias("half"))
    counts = kept(counts)
    histogram = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    n_halves = counts.agg(F.coalesce(F.sum("half"), F.lit(0)).alias("n")).first()["n"]
    patterns = plan(histogram, size, gap)
    table, first_half = dealt(patterns, size), sum(p.times for p in patterns)
    first_full = first_half + (n_halves + 1) // 2
    ranks = counts.select("part", "rest", F.expr("sum(n) over (partition by rest order by part) - n").alias("rank_before"))
    parts = counts.groupBy("part").agg(F.sum("full").alias("full"), F.sum("half").alias("half"))
    before = parts.select("part", F.expr("sum(full) over (order by part) - full").alias("full_by_part"), F.expr("sum(half) over (order by part) - half").alias("half_by_part"))
    placed = (
        found.join(ranks, ["part", "rest"])
        .join(before, "part")
        .select("doc_id", "doc_tokens", "crcs", "rest", (F.col("rank_before") + F.col("rank_in_part")).alias("rank"), (F.col("full_by_part") + F.col("full_before")).alias("full"), (F.col("half_by_part") + F.col("halves_before")).alias("half"))
    )
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def place(r: dict, k: int, length: int) -> tuple[int, int]:
        """Sequence and offset of a document's piece k."""
        if length == size:
            return first_full + r["full"] + k, 0
        if length == half:
            return first_half + r["half"] // 2, r["half"] % 2 * half
        rows = table[length]
        first, times, sequence, offset = rows[np.searchsorted(rows[:, 0], r["rank"], "right") - 1].tolist()
        i = r["rank"] - first
        return sequence + i // times, offset + i % times * length

    def pieces(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for k, (a, b) in enumerate(cuts(r["doc_tokens"], size)):
                    out.append((r["doc_id"], a, b - a, r["crcs"][k], r["doc_tokens"], *place(r, k, b - a)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return placed.mapInArrow(trimmed(pieces), schema)
