"""Substring dedup by fixed-block anchors.

A word of a document goes when a window of `window` words that covers it also starts in a document with a smaller id. Every repeat of
that length holds a whole block of half its length of the other document, cut at fixed places. So:
1. Blocks of all documents are indexed, every rolling window of a block's length probes them. What meets a block of another document is a
   hit; most text has none and is done with.
2. A hit is extended to both sides as far as a repeat can reach. The windows there, and no others, are compared by 128-bit hashes: each
   learns the smallest document it starts in. Windows that overlap make up the maximal repeats.
3. Each text drops the words of its repeats with smaller documents.
Exact copies of whole texts are found by digest, and only the smallest of each takes part in 1 and 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashes
from .hashes import ANSWERS, Deal, Entries, Gathered
from .text import attached, bounded, fresh, kept, spread, texts, trimmed, words

WINDOW = 50
#: Repeated ids that are broadcast at most.
FEW = 200_000


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and a 128-bit digest of the words of every row."""

    def run(batches):
        for batch in batches:
            found = [words(t) for t in batch.column("text").to_pylist()]
            both = [hashes.digest(np.frombuffer(b" ".join(w), np.uint8)) for w in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([len(w) for w in found], pa.int64()), pa.array([x[0] for x in both], pa.int64()), pa.array([x[1] for x in both], pa.int64())], names=["doc_id", "key", "n_words", "hi", "lo"])

    return docs.mapInArrow(trimmed(run), "doc_id long, key long, n_words long, hi long, lo long")


def identified(docs: DataFrame, doc_id: str = "doc_id", key: str = "key") -> DataFrame:
    """docs with a key that tells the texts of a doc_id apart: a hash of the text, but 0 where no other row has the doc_id.

    Packed values name their texts, and hashes are most of a name's bytes. A table with more than FEW repeated ids has hashes everywhere, so
    that texts need not be dealt by id.
    """
    several = kept(docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.count("*").alias(key)).where(F.col(key) > 1))
    n, hashed = several.count(), F.xxhash64(docs["text"].cast("string"))
    if n > FEW:
        return docs.withColumn(key, hashed)
    return docs.join(F.broadcast(several), doc_id, "left").withColumn(key, F.when(F.col(key).isNotNull(), hashed).otherwise(F.lit(0)).cast("long"))


def runs(positions: np.ndarray, reach: int, last: int) -> np.ndarray:
    """Starts and ends, one after the other, of the window starts within `reach` before the positions, from 0 to last."""
    if not len(positions):
        return positions
    low, high = np.maximum(positions - reach, 0), np.minimum(positions, last)
    fits = low <= high
    low, high = low[fits], high[fits]
    new = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1] + 1)))
    if not len(low):
        return low
    return np.stack([low[new], np.append(high[new[1:] - 1], high[-1])], axis=1).reshape(-1)


#: Kinds of entries on their way.
PROBES, BLOCKS = 0, 1


def found_at(ids: np.ndarray, keys: np.ndarray, positions: np.ndarray) -> Entries:
    """Positions on their way to the task that gets the text's others."""
    key = hashes.mixed(ids.view(np.uint64) ^ keys.view(np.uint64))
    order = np.lexsort((positions, keys, ids, key))
    key, ids, keys, positions = key[order], ids[order], keys[order], positions[order]
    one = hashes.first_of_runs(key, ids, keys)
    owner = np.zeros(len(ids), np.int64)
    owner[one[1:]] = 1
    return Entries(key, np.cumsum(owner), [hashes.small(positions)], [ids[one], keys[one]])


def indexed(h: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, with the smallest and largest document of each."""
    order = np.argsort(h, kind="stable")
    h, low, high = h[order], low[order], high[order]
    starts = hashes.first_of_runs(h)
    return (h[starts], np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)) if len(h) else (h, low, high)


def meets(h: np.ndarray, ids: np.ndarray, index: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which probes equal a block of another document."""
    if not len(index):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(index, h), len(index) - 1)
    return (index[at] == h) & ((low[at] != ids) | (high[at] != ids))


def spread_of_runs(sorted_keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, the smallest and the largest document that has its key here."""
    first = hashes.first_of_runs(sorted_keys)
    n = np.diff(np.append(first, len(sorted_keys)))
    return np.repeat(np.minimum.reduceat(ids, first), n), np.repeat(np.maximum.reduceat(ids, first), n)


def with_answers(got: Gathered, probes: Entries, hit: np.ndarray) -> Gathered:
    """What is left of the probes, and the hits besides the answers that there are."""
    answers = [got[ANSWERS]] if ANSWERS in got else []
    if hit.any():
        answers.append(found_at(probes.of(0)[hit], probes.of(1)[hit], probes.columns[0][hit]))
    out = {k: e for k, e in got.items() if k not in (PROBES, ANSWERS)} | {PROBES: probes.take(~hit)}
    return out | ({ANSWERS: Entries.merged(answers)} if answers else {})


def met(got: Gathered) -> Gathered:
    """Probes that meet a block of another document of the task, or a probe of one, are hits at once; of equal blocks one entry stays.

    So however many documents have a passage, a task sends one document's probes of it. A hit only makes step 2 look closer, so probes
    that met nothing but each other cost some work and change nothing.
    """
    out = dict(got)
    if BLOCKS in got:
        e = got[BLOCKS]
        out[BLOCKS] = Entries(*(x := indexed(e.keys, *e.columns))[:1], columns=list(x[1:]))
    if PROBES not in got or not len(got[PROBES]):
        return out
    probes = got[PROBES]
    ids = probes.of(0)
    low, high = spread_of_runs(probes.keys, ids)
    hit = low != high
    if BLOCKS in out:
        hit |= meets(probes.keys, ids, out[BLOCKS].keys, *out[BLOCKS].columns)
    return with_answers(out, probes, hit)


def answered(got: dict[int, list[Entries]], deal: Deal, hits_of) -> Iterator[pa.RecordBatch]:
    """Of a task's entries, the answers it got and those hits_of finds, on their way to their texts."""
    answers = [*got.get(ANSWERS, []), *hits_of(got)]
    if answers:
        yield deal.rows({PROBES: Entries.merged(answers)})


def hits(docs: DataFrame, window: int, buckets: int, to: Deal) -> DataFrame:
    """Where a rolling window of half the length equals a block of another document.

    48 bits are compared here: a chance equality costs step 2 some work and changes nothing.
    """
    block, deal = window // 2, Deal(buckets, 48, met)

    def rolling(batches):
        for batch in batches:
            for i, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                h = hashes.window_hashes(hashes.word_hashes(words(text)), block)
                if len(h) > window - block:
                    yield i, key, h >> np.uint64(16)

    def made(held):
        ids, keys = (np.array([x[c] for x in held], np.int64) for c in (0, 1))
        counts = [len(x[2]) for x in held]
        h, owner = np.concatenate([x[2] for x in held]), np.repeat(np.arange(len(held)), counts)
        position = np.arange(len(h)) - (np.cumsum(counts) - counts)[owner]
        at = np.flatnonzero(position % block == 0)
        blocks = Entries(*(x := indexed(h[at], ids[owner[at]], ids[owner[at]]))[:1], columns=list(x[1:]))
        return {PROBES: hashes.sorted_entries(h, owner, [hashes.small(position)], [ids, keys]), BLOCKS: blocks}

    def send(batches):
        for got in hashes.gathered(rolling(batches), deal.flush, made):
            yield deal.rows(got)

    def compare(batches):
        def hits_of(got):
            if BLOCKS in got:
                index = indexed(*(np.concatenate(c) for c in zip(*((e.keys, *e.columns) for e in got[BLOCKS]), strict=True)))
                for e in got.get(PROBES, []):
                    ids = e.of(0)
                    hit = meets(e.keys, ids, *index)
                    if hit.any():
                        yield found_at(ids[hit], e.of(1)[hit], e.columns[0][hit])

        yield from answered(hashes.received(batches), to, hits_of)

    return deal.exchanged(docs.mapInArrow(trimmed(send), hashes.SENT)).mapInArrow(trimmed(compare), hashes.SENT)


def smallest(got: Gathered) -> Gathered:
    """Entries (a; b, position) of windows that a smaller document of the task has too are answers; only those of the smallest are sent."""
    if PROBES not in got or not len(got[PROBES]):
        return got
    probes, later = later_ones(got[PROBES])
    return with_answers(got, Entries(probes.keys, probes.owner, probes.columns, probes.owners), later)


def later_ones(e: Entries) -> tuple[Entries, np.ndarray]:
    """Entries sorted by both hashes, and which of them have a smaller document with the same."""
    order = np.lexsort((e.columns[1], e.keys))
    e = e.take(order)
    ids = e.of(0)
    first = hashes.first_of_runs(e.keys, e.columns[1])
    least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(ids))))
    return e, ids > least


def repeated(docs: DataFrame, window: int, buckets: int, to: Deal) -> DataFrame:
    """The starts of windows, among those of the column ranges, that also start in a smaller document."""
    deal = Deal(buckets, 64, smallest)

    def windows(batches):
        for batch in batches:
            for i, key, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text", "ranges")), strict=True):
                h = hashes.word_hashes(words(text))
                a, b = hashes.window_hashes(h, window), hashes.window_hashes(h, window, 1)
                at = np.concatenate([np.empty(0, np.int64), *(np.arange(x, min(y + 1, len(a))) for x, y in zip(spans[::2], spans[1::2], strict=True))]).astype(np.int64)
                if len(at):
                    yield i, key, a[at], b[at], at

    def made(held):
        ids, keys = (np.array([x[c] for x in held], np.int64) for c in (0, 1))
        owner = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
        a, b, p = (np.concatenate([x[c] for x in held]) for c in (2, 3, 4))
        return {PROBES: hashes.sorted_entries(a, owner, [hashes.small(p), b], [ids, keys])}

    def send(batches):
        for got in hashes.gathered(windows(batches), deal.flush, made):
            yield deal.rows(got)

    def compare(batches):
        def hits_of(got):
            if PROBES in got:
                e, later = later_ones(Entries.merged(got[PROBES]))
                if later.any():
                    yield found_at(e.of(0)[later], e.of(1)[later], e.columns[0][later])

        yield from answered(hashes.received(batches), to, hits_of)

    return deal.exchanged(docs.mapInArrow(trimmed(send), hashes.SENT)).mapInArrow(trimmed(compare), hashes.SENT)


def ranges(found: DataFrame, reach: int, deal: Deal) -> DataFrame:
    """doc_id, key, ranges: the runs of window starts that a text's positions give, `reach` words back from each."""

    def run(batches):
        got = hashes.received(batches)
        if PROBES in got:
            e = Entries.merged(got[PROBES])
            ids, keys, positions = e.of(0), e.of(1), e.columns[0].astype(np.int64)
            order = np.lexsort((positions, keys, ids))
            ids, keys, positions = ids[order], keys[order], positions[order]
            one = hashes.first_of_runs(ids, keys)
            spans = [runs(p, reach, 1 << 40) for p in np.split(positions, one[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[one], pa.int64()), pa.array(keys[one], pa.int64()), pa.array(spans, pa.list_(pa.int64()))], names=["doc_id", "key", "ranges"])

    return deal.exchanged(found).mapInArrow(trimmed(run), "doc_id long, key long, ranges array<long>")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, ranges, copy: the runs of starts of windows that also start in a smaller document; copy: all of them do. Texts without any are missing."""
    own = docs.where("doc_id is not null")
    found = kept(digests(own).where(F.col("n_words") >= window))
    firsts = kept(found.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("n_words").alias("n_words")))
    copies = kept(found.join(firsts.where("first < last").drop("n_words"), ["hi", "lo"]).where("doc_id > first").select("doc_id", "key").distinct())
    total = firsts.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    buckets = spread(docs.sparkSession, total, hashes.PER_TASK)
    # step 1 reads copies too, as leaving them out would need the texts joined; their hits end here
    to = Deal(buckets)
    starts = kept(ranges(hits(own, window, buckets, to), window - window // 2, to).join(copies, ["doc_id", "key"], "left_anti"))
    smaller = ranges(repeated(attached(own, starts, ["doc_id", "key"], "inner"), window, buckets, to), 0, to)
    whole = copies.select("doc_id", "key", F.lit(None).cast("array<long>").alias("ranges"), F.lit(True).alias("copy"))
    return kept(smaller.select("doc_id", "key", "ranges", F.lit(False).alias("copy")).unionByName(whole))


def without(found: list[bytes], spans: list[int] | None, copy: bool | None, window: int) -> list[bytes]:
    """The words that no repeat covers. A copy's windows all repeat, so it has none left."""
    if copy:
        return []
    if not spans:
        return found
    out, at = [], 0
    for first, last in zip(spans[::2], spans[1::2], strict=True):
        out += found[at : max(at, first)]
        at = max(at, last + window)
    return out + found[at:]


def kept_texts(docs: DataFrame, window: int = WINDOW, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept of every row: the words that stay, joined by one space; with digest, kept_sha256 in its place.

    A null or empty text has no words; texts of fewer words than a window stay whole; windows are judged on the input. Rows with a null
    doc_id neither lose words nor cost others any. Rows with one doc_id are one document, whose texts cost each other nothing. An empty
    table gives none. Texts of any length.
    """
    own = identified(texts(docs, id_col, text_col))
    last = "kept_sha256" if digest else "kept"

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans, copy in zip(*(batch.column(c).to_pylist() for c in ("text", "ranges", "copy")), strict=True):
                w = words(text)
                left = without(w, spans, copy, window)
                joined = b" ".join(left)
                rows.append((len(w), len(w) - len(left), hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "surrogatepass")))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["doc_id", "n_words", "n_removed", last])

    return attached(own, repeats(own, window), ["doc_id", "key"], "left").mapInArrow(trimmed(run), f"doc_id long, n_words long, n_removed long, {last} string")


def rewritten(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs with all columns, whatever their names: where words go, text is what stays and n_chars its length; other texts don't change.

    Null and empty texts stay as they are, and so do rows of a null doc_id; repeated rows lose the same words; no rows give none.
    """
    bounded(docs.sparkSession)
    names, doc_id, key, ranges_, copy = docs.columns, *(fresh(docs, x) for x in ("own_id", "own_key", "own_ranges", "own_copy"))
    keyed = identified(docs.withColumn(doc_id, docs["doc_id"].cast("long")), doc_id, key)
    own = keyed.select(F.col(doc_id).alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(key).alias("key"))
    found = repeats(own, window).withColumnsRenamed({"doc_id": doc_id, "key": key, "ranges": ranges_, "copy": copy})

    def run(batches):
        for batch in batches:
            new, changed = [], []
            for text, spans, whole in zip(*(batch.column(c).to_pylist() for c in ("text", ranges_, copy)), strict=True):
                changed.append(bool(whole or spans))
                new.append(b" ".join(without(words(text), spans, whole, window)).decode("utf-8", "surrogatepass") if changed[-1] else text)
            made = {"text": pa.array(new, pa.string())}
            if "n_chars" in names:
                made["n_chars"] = pa.array([len(t) if x else n for t, x, n in zip(new, changed, batch.column("n_chars").to_pylist(), strict=True)], batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in names], names=names)

    return attached(keyed, found, [doc_id, key], "left").mapInArrow(trimmed(run), docs.schema)


#: The rows of kept_texts() with digests over documents whose ids are distinct and not null.
ORACLE = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, unnest(list_transform(range(1, cast(len(w) as bigint) - 48), lambda i: {'i': i, 'h': md5(array_to_string(w[i:i+49], ' '))})) as x from d where len(w) >= 50),
f as (select x.h as h, min(doc_id) as first from win group by 1),
r as (select doc_id, x.i as i from win join f on f.h = x.h where doc_id > first),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from r),
words as (select doc_id, unnest(w) as word, unnest(range(1, cast(len(w) as bigint) + 1)) as p from d),
left_ as (select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n from words anti join gone using (doc_id, p) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(left_.n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join left_ using (doc_id)
"""
