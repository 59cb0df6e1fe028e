"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts, give each word a probability. As in Kneser-Ney, a word counts by its continuations: the number
of distinct words that it follows in texts of the class, discounted by D. What is taken off goes to the next level, the word's stem (its
first letters), and from there to one that both classes share: a stem's share of all words, a word's of its stem. All that the sample has
is kept; a rare expression leans on its stem by the shared counts, and an unknown stem makes no difference. Both classes give the lower
levels the same weight, so that words which neither has seen favour none.

A text's toxic and ordinary log-likelihoods are compared by their difference, divided by the number of words: of the whole text, and of its
1, 2, 4 ... most toxic distinct words, as a long text is toxic if a few expressions in it are. A logistic curve over these means and the
length makes a score from 0 to 1. It is fitted on training rows, each measured by a model that hasn't seen it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import per_text, texts, trimmed

WORD = re.compile(r"\w+")
#: Entries that a task holds before it sends them.
HELD = 200_000


@dataclass(frozen=True)
class Options:
    #: At most so many labelled rows, those with the lowest checksums, are learnt from.
    sample: int = 8000
    discount: float = 0.75
    #: The weight of the next level, in both classes.
    backoff: float = 0.5
    stem: int = 5
    #: Of so many of a text's most toxic words the mean is taken, besides the whole text's.
    tops: tuple[int, ...] = (1, 2, 4, 8, 16, 32)
    #: Parts of the training rows; each is measured by the model of the others.
    folds: int = 2
    threshold: float = 0.7


def hashed(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


@dataclass
class Table:
    """Log-likelihood ratios, toxic over ordinary, by the hash of a word or stem."""

    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    ratios: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))

    @classmethod
    def of(cls, names: list[str], ratios: np.ndarray) -> Table:
        keys = hashed(names)
        order = np.argsort(keys)
        return cls(keys[order], ratios[order].astype(np.float32))

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios, and which keys there are."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.ratios[at].astype(float), self.keys[at] == keys


@dataclass
class Model:
    words: Table = field(default_factory=Table)
    stems: Table = field(default_factory=Table)
    options: Options = Options()
    #: Weights of measures() and a constant.
    curve: tuple[float, ...] = (0.0,) * (len(Options().tops) + 2) + (-20.0,)

    def ratios(self, words: list[str]) -> np.ndarray:
        """The difference of both log-likelihoods for each word; of one that no text has, that of its stem, else 0."""
        out, known = self.words.get(hashed(words))
        if not known.all():
            unknown = np.flatnonzero(~known)
            ratio, has = self.stems.get(hashed([words[i][: self.options.stem] for i in unknown]))
            out[unknown] = np.where(has, ratio, 0.0)
        return out

    def measures(self, text: str | None) -> list[float]:
        """Mean difference of the whole text, repeated words included, and of its most toxic distinct words; log of the length."""
        found = Counter(WORD.findall((text or "").lower()))
        tops = self.options.tops
        if not found:
            return [0.0] * (len(tops) + 2)
        each = self.ratios(list(found))
        n = found.total()
        upto = np.cumsum(-np.sort(-each))
        whole = float((each * np.fromiter(found.values(), float, len(found))).sum()) / n
        return [whole, *(float(upto[min(k, len(upto)) - 1]) / k for k in tops), math.log1p(n)]

    def score(self, text: str | None) -> float:
        *weights, constant = self.curve
        z = sum(w * x for w, x in zip(weights, self.measures(text), strict=True)) + constant
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame, options: Options) -> DataFrame:
    """text, toxic, fold of the sample. Labels of crc32(doc_id as text) mod 3 = 1 are held out; of several labels of a document the highest counts."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    usable = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where((crc % 3 != 1) & F.col("toxic").isin(0, 1))
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.crc32(F.concat(F.lit("sample "), F.col("doc_id").cast("string"))), "doc_id").limit(options.sample)
    return texts(docs).join(F.broadcast(sample), "doc_id").select("text", "toxic", (F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string"))) % options.folds).cast("int").alias("fold"))  # at most options.sample rows of two numbers


def counted(rows: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """word, a0, a1, b0, b1 ...: how many distinct words it follows in ordinary and toxic texts; and stem, the same: how many texts have it.

    a: in all folds, b and so on: without one of them. A pair carries the folds that have it as bits, one number for each class. Tasks
    gather what they send.
    """

    def sent(level: int, found: dict) -> pa.RecordBatch:
        a, b = zip(*found, strict=True)
        values = zip(*found.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([level] * len(a), pa.int32()), pa.array(a, pa.string()), pa.array(b, pa.string()), *(pa.array(v, pa.int64()) for v in values)], names=["level", "a", "b", "ordinary", "toxic"])

    def run(batches):
        pairs, stems = {}, {}
        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                w = WORD.findall((text or "").lower())
                for p in set(zip(["", *w], w)):
                    pairs.setdefault(p, [0, 0])[toxic] |= 1 << fold
                for z in {x[: options.stem] for x in w}:
                    stems.setdefault((z, str(fold)), [0, 0])[toxic] += 1
                if len(pairs) + len(stems) > HELD:
                    yield from (sent(k, x) for k, x in ((1, pairs), (0, stems)) if x)
                    pairs, stems = {}, {}
        yield from (sent(k, x) for k, x in ((1, pairs), (0, stems)) if x)

    each = rows.mapInArrow(trimmed(run), "level int, a string, b string, ordinary long, toxic long")
    both = each.groupBy("level", "a", "b").agg(*(F.when(F.col("level") == 1, F.bit_or(c)).otherwise(F.sum(c)).alias(c) for c in ("ordinary", "toxic"))).cache()
    every, classes = (1 << options.folds) - 1, ("ordinary", "toxic")
    folds = [None, *range(options.folds)]
    has = lambda c, k: F.sum((F.col(c).bitwiseAND(F.lit(every if k is None else every & ~(1 << k))) != 0).cast("long"))
    number = lambda c, k: F.sum(F.col(c) if k is None else F.when(F.col("b") != str(k), F.col(c)).otherwise(0))
    words = both.where("level = 1").groupBy(F.col("b").alias("name")).agg(*(has(c, k).alias(f"{c}_{i}") for i, k in enumerate(folds) for c in classes))
    stems = both.where("level = 0").groupBy(F.col("a").alias("name")).agg(*(number(c, k).alias(f"{c}_{i}") for i, k in enumerate(folds) for c in classes))
    return words, stems


def compared(words: list[str], counts: np.ndarray, stems: list[str], texts_with: np.ndarray, options: Options) -> Model:
    """The model of words and stems with their counts in ordinary and toxic texts, arrays of two columns; empty if a class has none."""
    there, model = counts.sum(axis=1) > 0, Model(options=options)
    place = {z: i for i, z in enumerate(stems)}
    names = [w for w, x in zip(words, there.tolist(), strict=True) if x]
    stem = np.array([place[w[: options.stem]] for w in names], np.int64)
    share = np.bincount(stem, minlength=len(stems)).astype(float) if len(stem) else np.zeros(len(stems))
    own, lower = np.maximum(counts[there] - options.discount, 0), np.maximum(texts_with - options.discount, 0)
    if not len(names) or not own.sum(axis=0).all() or not lower.sum(axis=0).all():
        return model
    rest = options.backoff
    by_stem = (1 - rest) * lower / lower.sum(axis=0) + rest * (share / share.sum())[:, None]
    by_word = (1 - rest) * own / own.sum(axis=0) + rest * by_stem[stem] / share[stem][:, None]
    used = share > 0
    model.words = Table.of(names, np.log(by_word[:, 1] / by_word[:, 0]))
    model.stems = Table.of([z for z, x in zip(stems, used.tolist(), strict=True) if x], np.log(by_stem[used, 1] / by_stem[used, 0]))
    return model


def models(rows: DataFrame, options: Options) -> list[Model]:
    """The model of all rows, and for each fold that of the others. What reaches the driver are the sample's distinct words, with two counts for each model."""
    tables = [df.toArrow() for df in counted(rows, options)]
    names = [t["name"].to_pylist() for t in tables]
    of = lambda t, i: np.stack([t[f"{c}_{i}"].to_numpy() for c in ("ordinary", "toxic")], axis=1).astype(float)
    return [compared(names[0], of(tables[0], i), names[1], of(tables[1], i), options) for i in range(options.folds + 1)]


def solved(m: list[list[float]], y: list[float]) -> list[float]:
    """A small system of linear equations, by elimination."""
    rows = [[*r, v] for r, v in zip(m, y, strict=True)]
    for i in range(len(rows)):
        k = max(range(i, len(rows)), key=lambda j: abs(rows[j][i]))
        rows[i], rows[k] = rows[k], rows[i]
        rows[i] = [v / rows[i][i] for v in rows[i]]
        rows = [r if j == i else [v - r[i] * w for v, w in zip(r, rows[i], strict=True)] for j, r in enumerate(rows)]
    return [r[-1] for r in rows]


def fitted(x: np.ndarray, y: np.ndarray, rising: int) -> tuple[float, ...]:
    """Weights of a logistic curve over the columns of x and a constant, by Newton's method with a small penalty.

    More of one of the first `rising` columns never lowers a score: a column that would is left out, and the others are fitted again.
    """
    used = list(range(x.shape[1]))
    while True:
        scale = np.append(np.maximum(np.abs(x[:, used]).max(axis=0), 1e-9), 1.0)
        own = np.column_stack([x[:, used], np.ones(len(x))]) / scale
        w = np.zeros(own.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip((own * w).sum(axis=1), -500, 500)))
            gradient = ((p - y)[:, None] * own).sum(axis=0) + 0.01 * w
            curvature = [[float((p * (1 - p) * own[:, i] * own[:, j]).sum()) + 0.01 * (i == j) for j in range(len(w))] for i in range(len(w))]
            step = np.array(solved(curvature, gradient.tolist()))
            w = w - step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
            if np.abs(step).max() < 1e-7:
                break
        w = w / scale
        worst = min((i for i, c in enumerate(used) if c < rising), key=lambda i: w[i] * scale[i], default=None)
        if worst is None or w[worst] >= 0:
            out = dict(zip(used, w.tolist()))
            return (*(out.get(c, 0.0) for c in range(x.shape[1])), float(w[-1]))
        del used[worst]


def measured(rows: DataFrame, by_fold: list[Model]) -> list[tuple[list[float], int]]:
    """What its fold's model measures of each of at most options.sample rows, and their labels."""
    held = rows.sparkSession.sparkContext.broadcast(by_fold)  # bounded as models() says

    def run(batches):
        for batch in batches:
            x = [held.value[k].measures(t) for t, k in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "y"])

    out = [(r["x"], r["y"]) for r in rows.mapInArrow(trimmed(run), "x array<double>, y int").collect()]
    held.unpersist()
    return out


def learn(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> Model:
    """The model of the labelled sample; without rows of both classes every score is near 0. Its size is that of the sample's vocabulary.

    The curve is fitted on what models of the other folds measure, as rows look further apart to a model that has learnt from them. If
    a fold leaves no rows of both classes, all are measured by the model itself.
    """
    rows = training_rows(docs, labels, options).cache()
    model, *others = models(rows, options)
    if len(model.words.keys):
        known = sorted(measured(rows, others if all(len(m.words.keys) for m in others) else [model] * options.folds))
        model.curve = fitted(np.array([x for x, _ in known]), np.array([y for _, y in known], float), 1 + len(options.tops))
    rows.unpersist()
    return model


def scores(docs: DataFrame, labels: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Only the text is an input of a score: equal texts have equal scores, and other columns, whatever their names, are not read. A null or
    empty text scores as one without any word; repeated rows repeat; held_out is null where doc_id is; a score of exactly the threshold
    counts as toxic; an empty table gives no rows. The whole text is read, however long.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, options))  # bounded by the sample's vocabulary

    def rows(text):
        s = model.value.score(text)
        return s, int(s >= options.threshold)

    schema = "doc_id long, score double, predicted int"
    found = texts(docs, id_col, text_col).mapInArrow(per_text(schema, rows, ["score", "predicted"]), schema)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", "predicted")


def harmless(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """The rows of docs, with all columns, whose text scores below the threshold. One pass, no shuffle.

    Rows with a null or empty text stay, repeated rows stay or go together, and columns of any name pass through. No rows give none.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, options))  # bounded by the sample's vocabulary

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.value.score(t) < options.threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
