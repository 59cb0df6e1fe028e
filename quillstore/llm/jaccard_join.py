"""N-gram Jaccard join by prefix trees.

Every text is its set of word n-grams, as 64-bit hashes. Two sets are linked when their Jaccard similarity reaches the threshold. Exactly:
1. Equal sets become one node. A node with more n-grams that no other node has than its similarity allows has no links and is settled:
   one exchange counts them. Part of a node's n-grams mostly shows it: the exchange has those whose hashes a number
   divides, of all nodes, so one that is alone there is alone. Nodes that aren't settled by these go on to the exact steps.
2. What is left is globally ordered, n-grams of few nodes first. Similar sets share an n-gram in their prefixes, so nodes that do are in
   one block, and no link leaves a block.
3. In parts of a block, sets that have enough n-grams in common with others go into a trie, the commonest n-gram first. A set walks it with
   one overlap for all sets that share a path; subtrees go that are out of reach by their sizes and remaining lengths, or whose sets all are
   in the set's component already. So a group of near copies costs a walk for each, not one for each pair.
Links are contracted to components.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashes
from .components import components
from .hashes import Deal, Entries, Gathered
from .text import attached, kept, spread, texts, trimmed

#: N-grams of a part of a block.
PART = 60_000


def ngrams(text: str | None, n: int = 5) -> np.ndarray:
    """A text's distinct n-grams of words, A to Z lower-cased, sorted; all words as one where there are fewer; none without words."""
    found = [] if not text else text.encode("utf-8", "surrogatepass").lower().split()  # of bytes, only A to Z change
    if not found:
        return np.empty(0, np.uint64)
    h = hashes.word_hashes(found)
    if len(h) < n:
        return hashes.mixed(hashes.window_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(hashes.window_hashes(h, n))


def needed(n, percent: int):
    """The least overlap of a set of n with any similar one."""
    return -(-percent * n // 100)


def divisor(percent: int) -> int:
    """Step 1 counts the n-grams whose hashes this divides: 3 at 80 %, where a third of a set is well over the fifth that must be lone."""
    return min(8, max(1, 60 // max(1, 100 - percent)))


def sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and the set's 128-bit digest of every row."""

    def run(batches):
        for batch in batches:
            found = [ngrams(t, n) for t in batch.column("text").to_pylist()]
            both = [hashes.digest(x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array([x[0] for x in both], pa.int64()), pa.array([x[1] for x in both], pa.int64())], names=["doc_id", "n_shingles", "hi", "lo"])

    return docs.mapInArrow(trimmed(run), "doc_id long, n_shingles long, hi long, lo long")


def twice(got: Gathered) -> Gathered:
    """Each n-gram with two of its sets at most: enough to tell that several have it, so what is common is sent few times."""
    e = got[0]
    sig = e.of(0)
    order = np.lexsort((sig, e.keys))
    e, sig = e.take(order), sig[order]
    e = e.take(hashes.first_of_runs(e.keys, sig))  # equal sets of different tasks are one
    starts = hashes.first_of_runs(e.keys)
    rank = np.arange(len(e)) - np.repeat(starts, np.diff(np.append(starts, len(e))))
    return {0: e.take(rank < 2)}


def added(got: Gathered) -> Gathered:
    """Keys with the sums of their counts."""
    return {0: summed([got[0]])}


def summed(parts: list[Entries]) -> Entries:
    one, inverse = np.unique(np.concatenate([e.keys for e in parts]), return_inverse=True)
    return Entries(one, columns=[np.bincount(inverse, weights=np.concatenate([e.columns[0] for e in parts]), minlength=len(one)).astype(np.uint64)])


def lone(docs: DataFrame, n: int, buckets: int, every: int = 1) -> DataFrame:
    """lo, lone: for each set, how many of its n-grams with hashes that `every` divides no other set has. Sets without any are missing.

    So a set has that many lone n-grams at least. N-grams are compared by 48 bits; a chance equality can only make the count too low, too,
    which keeps a node for the exact steps.
    """
    by_ngram, by_set = Deal(buckets, 48, twice), Deal(buckets, 64, added)

    def distinct(batches):
        for batch in batches:
            for text in batch.column("text").to_pylist():
                x = ngrams(text, n)
                shown = x[x % np.uint64(every) == 0]
                if len(shown):
                    yield hashes.digest(x)[1], shown

    def made(held):
        held = list(dict(held).items())  # equal sets once
        t = np.concatenate([x for _, x in held]) >> np.uint64(16)
        return {0: hashes.sorted_entries(t, np.repeat(np.arange(len(held)), [len(x) for _, x in held]), [], [np.array([s for s, _ in held], np.int64)])}

    def send(batches):
        for got in hashes.gathered(distinct(batches), by_ngram.flush, made):
            yield by_ngram.rows(got)

    def count(batches):
        got = hashes.received(batches)
        if 0 in got:
            e = Entries.merged(got[0])
            sig = e.of(0)
            order = np.lexsort((sig, e.keys))
            t, sig = e.keys[order], sig[order]
            one = hashes.first_of_runs(t, sig)
            t, sig = t[one], sig[one]
            starts = hashes.first_of_runs(t)
            single = sig[starts[np.diff(np.append(starts, len(t))) == 1]].view(np.uint64)
            if len(single):
                yield by_set.rows({0: Entries(np.sort(single), columns=[np.ones(len(single), np.uint64)])})

    def add(batches):
        got = hashes.received(batches)
        if 0 in got:
            e = summed(got[0])
            yield pa.RecordBatch.from_arrays([pa.array(e.keys.view(np.int64)), pa.array(e.columns[0].astype(np.int64))], names=["lo", "lone"])

    counted = by_ngram.exchanged(docs.mapInArrow(trimmed(send), hashes.SENT)).mapInArrow(trimmed(count), hashes.SENT)
    return by_set.exchanged(counted).mapInArrow(trimmed(add), "lo long, lone long")


def blocks(nodes: DataFrame, percent: int) -> DataFrame:
    """node, block: nodes (node, n, tokens) that share an n-gram of their prefixes, and so on. Nodes that share none are missing."""
    each = nodes.select("node", F.explode("tokens").alias("token"))
    common = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = each.join(common, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    # n-grams of one node come first in the order: only what a prefix has beyond them can be shared
    room = F.expr(f"n - (({percent} * n + 99) div 100) + 1 - (n - size(shared))").cast("int")
    prefix = nodes.select("node", "n").join(ordered, "node").withColumn("room", room).where("room > 0").select("node", F.explode(F.slice("shared", F.lit(1), F.col("room"))).alias("x"))
    prefix = kept(prefix.select("node", F.col("x.token").alias("token")))
    least = prefix.groupBy("token").agg(F.min("node").alias("first"))
    return components(prefix.join(least, "token").select(F.col("node").alias("a"), F.col("first").alias("b"))).withColumnRenamed("component", "block")


class Trie:
    """Sets of numbers in ascending order, as paths; nodes hold runs of numbers."""

    __slots__ = ("run", "below", "ends", "low", "high", "deep", "one", "alike")

    def __init__(self, run: list[int]):
        self.run, self.below, self.ends = run, {}, []
        #: Sizes of the sets at or under this node; the longest path under it; one of them, and whether all were in its component when last seen.
        self.low, self.high, self.deep, self.one, self.alike = 1 << 60, 0, 0, -1, True

    def take(self, which: int, size: int, rest: int, root) -> None:
        self.low, self.high, self.deep = min(self.low, size), max(self.high, size), max(self.deep, rest)
        if self.one < 0:
            self.one = which
        elif self.alike and root(self.one) != root(which):
            self.alike = False

    def insert(self, which: int, n: int, path: list[int], root) -> None:
        """Adds a set of n numbers, of which the path has those that count."""
        node, at, size = self, 0, len(path)
        node.take(which, n, size, root)
        while at < size:
            child = node.below.get(path[at])
            if child is None:
                child = node.below[path[at]] = Trie(path[at:])
                at = size
            else:
                run, k = child.run, 0
                most = min(len(run), size - at)
                while k < most and run[k] == path[at + k]:
                    k += 1
                if k < len(run):
                    upper = Trie(run[:k])
                    upper.low, upper.high, upper.deep, upper.one, upper.alike = child.low, child.high, child.deep + len(run) - k, child.one, child.alike
                    child.run = run[k:]
                    upper.below[run[k]] = child
                    node.below[path[at]] = upper
                    child = upper
                at += k
            child.take(which, n, size - at, root)
            node = child
        node.ends.append((which, n))

    def similar(self, which: int, n: int, path: list[int], percent: int, root, join) -> None:
        """Joins `which`, a set of n numbers with this path, to every set here that is similar and not yet in its component."""
        own, most = set(path), len(path)
        stack = [(self, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.alike and root(node.one) == root(which):
                continue
            # the least overlap that a set of size s needs is (s + n) * percent / (100 + percent)
            if 100 * node.high < percent * n or percent * node.low > 100 * n:
                continue
            need = (node.low + n) * percent
            if node.run:
                if (100 + percent) * (overlap + min(most, len(node.run) + node.deep)) < need:
                    continue
                overlap += len(own.intersection(node.run))
                if (100 + percent) * (overlap + min(most - bisect_right(path, node.run[-1]), node.deep)) < need:
                    continue
            for other, size in node.ends:
                if 100 * overlap >= percent * (n + size - overlap):
                    join(which, other)
            stack += [(child, overlap) for child in node.below.values()]


def shared(first: list[np.ndarray], second: list[np.ndarray], percent: int) -> list[tuple[int, list[int]]]:
    """Index and path of each set that can have a link: its n-grams that another set has (with a second: one of the other side), commonest first.

    Only these are in an overlap. A set that has fewer than any link needs has none and is left out, and then others' n-grams may be lone, too.
    """
    both = [*first, *second]
    sizes = np.array([len(x) for x in both])
    owner = np.repeat(np.arange(len(both)), sizes)
    tokens, place = np.unique(np.concatenate(both), return_inverse=True)
    least = needed(sizes, percent)
    here = np.ones(len(both), bool)
    while True:
        alive = here[owner]
        if second:
            mine = owner < len(first)
            n, m = (np.bincount(place[alive & side], minlength=len(tokens)) for side in (mine, ~mine))
            often = np.where((n > 0) & (m > 0), n + m, 0)
        else:
            often = np.bincount(place[alive], minlength=len(tokens))
            often[often < 2] = 0
        counts = alive & (often[place] > 0)
        left = here & (np.bincount(owner[counts], minlength=len(both)) >= least)
        if (left == here).all():
            break
        here = left
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -often))] = np.arange(len(tokens))
    owner, place = owner[counts], rank[place[counts]]
    order = np.lexsort((place, owner))
    edges = np.searchsorted(owner, np.arange(len(both) + 1))
    place = place[order].tolist()
    return [(i, place[edges[i] : edges[i + 1]]) for i in np.flatnonzero(here).tolist()]


def linked(first: list[np.ndarray], second: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links among first or, if there is a second, between the two, as far as they join components. Indices count on from first to second.

    known: the component of each so far, if any is known.
    """
    sizes = [len(x) for x in (*first, *second)]
    leads: dict[int, int] = {}
    up, out = [leads.setdefault(c, i) for i, c in enumerate(known)] if known else list(range(len(sizes))), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((i, j))

    trie = Trie([])
    for i, path in shared(first, second, percent):
        if i >= len(first) or not second:
            trie.similar(i, sizes[i], path, percent, root, join)
        if i < len(first):
            trie.insert(i, sizes[i], path, root)
    return out


def parted(nodes: DataFrame) -> DataFrame:
    """nodes with part and parts: those of a block in parts of about PART n-grams each. Blocks of one node are left out."""
    sizes = nodes.groupBy("block").agg(F.count("*").alias("members"), F.sum("n").alias("volume")).where("members > 1")
    own = sizes.select("block", F.expr(f"cast(least(members, (volume + {PART - 1}) div {PART}) as int)").alias("parts"))
    return nodes.join(own, "block").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def alone(nodes: DataFrame, percent: int) -> DataFrame:
    """a, b: links within each part."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("node", kind="stable")
        ids = cell["node"].tolist()
        got = linked([np.asarray(x) for x in cell["tokens"]], [], percent) if len(ids) > 1 else []
        return pd.DataFrame([(ids[a], ids[b]) for a, b in got], columns=["a", "b"], dtype="int64")

    return nodes.select("block", "part", "node", "tokens").groupBy("block", "part").applyInPandas(run, "a long, b long")


def across(sides: DataFrame, percent: int) -> DataFrame:
    """a, b: links between both sides (0, 1) of each cell, of nodes that aren't in one component yet."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["side", "node"], kind="stable")
        ids, n = cell["node"].tolist(), int((cell["side"] == 0).sum())
        tokens = [np.asarray(x) for x in cell["tokens"]]
        got = linked(tokens[:n], tokens[n:], percent, cell["component"].tolist()) if 0 < n < len(ids) else []
        return pd.DataFrame([(ids[a], ids[b]) for a, b in got], columns=["a", "b"], dtype="int64")

    return sides.groupBy("block", "i", "j").applyInPandas(run, "a long, b long")


def links(nodes: DataFrame, block: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join all components of nodes (node, n, tokens).

    Blocks are cut into parts of a bounded number of n-grams, in which links are looked for first. Of a block of several parts, one node
    for each part and component is then compared with the others: a group of near copies is one component after that. What is left to
    compare are the nodes outside the block's largest component with all of the block, by cells of a part of either: the work is the
    block times what isn't in that component, not the block's square.
    """
    own = kept(parted(nodes.join(block, "node")))
    edges = kept(alone(own, percent))
    wide = own.where("parts > 1")
    if wide.isEmpty():
        return edges

    def named(found: DataFrame) -> DataFrame:
        return wide.join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))

    leaders = named(edges).groupBy("block", "part", "component").agg(F.min("node").alias("node")).select("node").distinct()
    more = kept(alone(parted(wide.drop("part", "parts").join(leaders, "node")), percent))
    edges = edges.unionByName(more)
    now = kept(named(edges))
    sizes = now.groupBy("block", "component").agg(F.sum("n").alias("volume"))
    largest = sizes.groupBy("block").agg(F.max_by("component", F.struct("volume", "component")).alias("largest"))
    others = now.join(largest, "block").where("component <> largest")
    volume = others.groupBy("block").agg(F.expr(f"cast((sum(n) + {PART - 1}) div {PART} as int)").alias("cuts"))
    each = now.join(volume, "block").select("block", "node", "component", "tokens", F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("j"), F.lit(0).alias("side"))
    minor = others.join(volume, "block").select("block", "node", "component", "tokens", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int").alias("j"), F.lit(1).alias("side"))
    return edges.unionByName(kept(across(each.unionByName(minor), percent)))


def same_ids(found: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b: links between the nodes of one doc_id's different sets."""
    several = kept(found.groupBy("doc_id").agg(F.min(F.struct("hi", "lo", "n_shingles")).alias("x"), F.max(F.struct("hi", "lo", "n_shingles")).alias("y")).where("x <> y").select("doc_id"))
    of = attached(found, several, "doc_id", "left_semi").join(groups, ["hi", "lo", "n_shingles"]).select("doc_id", "node").distinct()
    least = of.groupBy("doc_id").agg(F.min("node").alias("least"))
    return of.join(least, "doc_id").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id that links of at least `percent` hundredths reach.

    Rows without words (null and empty texts) have no n-grams and are their own component. Rows of a null doc_id have a null component
    and link nothing. Repeated rows repeat; rows of one doc_id with different texts count as one document with several sets. Any length
    of text. An empty table gives none. Sets are compared by 64-bit hashes of n-grams.
    """
    own = texts(docs, id_col, text_col)
    spark = docs.sparkSession
    found = kept(sets(own, n))
    usable = found.where("doc_id is not null and n_shingles > 0")
    groups = kept(usable.groupBy("hi", "lo", "n_shingles").agg(F.min("doc_id").alias("node")))
    total = groups.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    every = divisor(percent)
    few = kept(lone(own.where("doc_id is not null"), n, spread(spark, -(-total // every), hashes.PER_TASK), every))
    left = groups.join(few, "lo", "left").where(F.expr(f"coalesce(lone, 0) <= n_shingles - ({percent} * n_shingles + 99) div 100"))
    left = kept(left.select(F.col("node").alias("doc_id"), "hi", "lo"))

    def tokens(batches):
        for batch in batches:
            rows = [(i, x) for i, t, hi, lo in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "hi", "lo")), strict=True) if hashes.digest(x := ngrams(t, n)) == (hi, lo)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([r[1].view(np.int64) for r in rows], pa.list_(pa.int64()))], names=["node", "n", "tokens"])

    nodes = kept(attached(own, left, "doc_id", "inner").mapInArrow(trimmed(tokens), "node long, n long, tokens array<long>"))
    block = kept(blocks(nodes, percent))
    joined = components(links(nodes, block, percent).unionByName(same_ids(usable, groups)))
    named = groups.join(joined, "node", "left").select(F.col("hi").alias("g_hi"), F.col("lo").alias("g_lo"), F.coalesce("component", "node").alias("component"))
    return found.join(named, (found["hi"] == F.col("g_hi")) & (found["lo"] == F.col("g_lo")) & (found["n_shingles"] > 0) & found["doc_id"].isNotNull(), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all columns, of one document of each group: that of the smallest doc_id, one row of it. Rows of a null doc_id stay.

    Null and empty texts link with nothing and stay, but of rows with one doc_id only the least stays; columns of any name pass through; no
    rows give none. Only ids are joined to texts; texts are dealt by key only where a doc_id has several rows.
    """
    found = kept(join(docs, n, percent))
    gone = kept(found.where("component_id <> doc_id").select("doc_id").distinct())
    several = kept(found.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    stay = attached(docs, gone, "doc_id", "left_anti")
    others = [c for c in docs.columns if c != "doc_id"]
    first = attached(stay, several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row")).select("doc_id", "row.*")
    return attached(stay, several, "doc_id", "left_anti").unionByName(first.select(*docs.columns))


#: The rows of join() over documents whose ids are distinct and not null.
ORACLE = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [md5(array_to_string(w, ' '))]
  else list_distinct(list_transform(range(1, cast(len(w) as bigint) - 3), lambda i: md5(array_to_string(w[i:i+4], ' ')))) end as g from d),
e as (select doc_id, len(g) as n, unnest(g) as h from s),
pairs as (select x.doc_id as a, y.doc_id as b, x.n as na, y.n as nb, count(*) as k from e x join e y on x.h = y.h and x.doc_id <> y.doc_id group by all),
links as (select a, b from pairs where 100 * k >= 80 * (na + nb - k)),
reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b)
select s.doc_id, cast(len(g) as bigint) as n_shingles, least(s.doc_id, coalesce(m.least, s.doc_id)) as component_id
from s left join (select a, min(b) as least from reach group by 1) m on m.a = s.doc_id
"""
