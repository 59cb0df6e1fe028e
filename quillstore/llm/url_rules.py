"""URL filters: listed rules first, then association rules that Spark's FP-growth mines from labelled URLs.

A URL is a set of tokens: every suffix of its host at a dot, and every path segment with its depth. Tokens that the same labelled URLs have
are one item, so that a path of many shared segments isn't a set of exponentially many patterns. A URL with more items than `width` is mined
as several baskets that have every combination of it. Combinations of items that mostly come with
the label `block` become rules, if support and confidence suffice, several listed rules stand behind them, and no part of the combination
is one already. To match, each rule stands in an inverted index under its rarest token, so a URL looks only at rules that it shares a token
with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations, islice

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bounded, kept, trimmed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "=block"


@dataclass(frozen=True)
class Options:
    #: Blocked URLs that a rule has at least: so many, and such a share of all labelled ones.
    min_count: int = 10
    min_share: float = 0.0001
    min_confidence: float = 0.9
    #: Listed rules whose pages a mined rule covers at least. One that covers a single rule's pages only restates it, with less of it.
    sources: int = 2
    #: Items of a rule at most.
    items: int = 3
    #: Items of a basket at most, so that it adds to 2 ** width patterns. A URL of more items becomes several baskets, in which all its
    #: combinations of `items` items are; what is found is counted over all tokens of all URLs.
    width: int = 10


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A to Z lower-cased, and path; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)


def split_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path of every row; null urls have empty parts."""
    own = pages.select(pages[id_col].cast("long").alias("page_id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("u"))
    host, path = parts(F.col("u"))
    return own.select("page_id", host.alias("host"), path.alias("path"))


def listed(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest of (verdict, host, path) that fits; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """A URL's distinct tokens, from host and path."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    hosts = F.when(F.size(labels) > 0, F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("host "), F.concat_ws(".", F.slice(labels, -k, k))))).otherwise(F.array().cast("array<string>"))
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    return F.array_distinct(F.concat(hosts, F.transform(segments, lambda x, i: F.concat_ws(" ", F.lit("path"), i, x))))


def items(rows: DataFrame, least: int, options: Options) -> tuple[DataFrame, dict[str, tuple[list[str], int, bool]]]:
    """blocked, items array<string> of the rows that have any, those of most blocked URLs first; and of each item the tokens, the number of
    rows and whether combinations are mined with it.

    No combination has an item that fewer than `least` blocked URLs have or fewer than `sources` listed rules stand behind, and one that is
    a rule by itself makes any with it superfluous; these are in no row. On the driver is a row for each token that `least` blocked URLs
    have: at most tokens of a URL / min_share of them.
    """
    each = rows.select("row", "blocked", "source", F.explode("tokens").alias("token"))
    digest = F.xxhash64("row")
    source = F.when(F.col("blocked"), F.coalesce("source", F.lit("")))
    # a token's rows are few sources' mostly, so first by both
    parts_ = each.groupBy("token", source.alias("source")).agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("hits"), F.bit_xor(digest).alias("x"), F.bit_xor(F.xxhash64(digest)).alias("y"))
    alike = parts_.groupBy("token").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count("source").alias("sources"))
    frequent = kept(alike.where((F.col("hits") >= least) & (F.col("sources") >= options.sources)))
    own = frequent.groupBy("n", "hits", "x", "y").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("all")).withColumn("mined", F.col("hits") < options.min_confidence * F.col("n"))
    names = {r["item"]: (r["all"], r["n"], r["mined"]) for r in own.collect()}
    chosen = each.join(own.where("mined").select(F.col("item").alias("token"), "hits"), "token").groupBy("row", "blocked").agg(F.sort_array(F.collect_list(F.struct((-F.col("hits")).alias("hits"), "token"))).alias("found"))
    return chosen.select("blocked", F.transform("found", lambda x: x["token"]).alias("items")), names


def covered(found: list[str], size: int, width: int) -> Iterator[list[str]]:
    """Parts of at most `width` of the items (or `size`, if that is more), such that every combination of `size` of them is in one."""
    if len(found) <= width:
        yield found
        return
    step = max(1, width // size)
    groups = [found[i : i + step] for i in range(0, len(found), step)]
    for some in combinations(groups, min(size, len(groups))):
        yield [x for g in some for x in g]


def baskets(found: DataFrame, options: Options) -> tuple[DataFrame, bool]:
    """items array<string> with the label of rows (blocked, items), and whether these are parts of rows.

    Parts have a row's combinations several times, so their counts are too high: all that is frequent in them among blocked rows has to be
    counted again, whatever its confidence there. Other rows aren't parted.
    """
    label = F.when(F.col("blocked"), F.array(F.lit(LABEL))).otherwise(F.array().cast("array<string>"))
    if found.where(F.size("items") > options.width).isEmpty():
        return found.select(F.concat("items", label).alias("items")), False

    def run(batches):
        for batch in batches:
            for own in batch.column("items").to_pylist():
                parts_ = covered(own, options.items, options.width)
                while some := [[*x, LABEL] for x in islice(parts_, 1000)]:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.string()))], names=["items"])

    return found.where("blocked").select("items").mapInArrow(trimmed(run), "items array<string>"), True


def matcher(found: list[tuple[str, ...]]):
    """A function from a URL's tokens to the places of the found combinations in it, by an inverted index of each one's first token."""
    index: dict[str, list[int]] = {}
    for i, c in enumerate(found):
        index.setdefault(c[0], []).append(i)

    def matches(tokens: list[str]) -> list[int]:
        have = set(tokens)
        return [i for t in sorted(have) for i in index.get(t, ()) if have.issuperset(found[i])]

    return matches


def mined(labelled: DataFrame, options: Options = Options()) -> list[tuple[str, ...]]:
    """Token combinations that predict `block`, the rarest token first, from rows (tokens array<string>, blocked boolean, source). All rows count.

    source names what a row's label comes from; a null one counts as a source of its own. No rows, or none blocked, give none.
    """
    rows = kept(labelled.withColumn("row", F.monotonically_increasing_id()))
    total, blocked = rows.agg(F.count("*"), F.sum(F.col("blocked").cast("long"))).first()
    if not blocked:
        return []
    least = max(options.min_count, -(-int(total * options.min_share * 1_000_000) // 1_000_000))
    found, names = items(rows, least, options)
    parted, several = baskets(kept(found), options)
    parted = kept(parted)
    n = parted.count()
    antecedents = [[i] for i, (_, _, mined_) in names.items() if not mined_]
    if n:
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=0.0 if several else options.min_confidence / 2).fit(parted)
        rules = model.associationRules.where((F.size("consequent") == 1) & F.array_contains("consequent", LABEL) & (F.size("antecedent") <= options.items))
        antecedents += [r["antecedent"] for r in rules.select("antecedent").collect()]
    if not antecedents:
        return []
    rarest = lambda c: tuple(sorted(c, key=lambda t: (names[t][1] if t in names else 0, t)))
    candidates = [rarest(t for i in a for t in names[i][0]) for a in antecedents]
    matches = matcher(candidates)

    def run(batches):
        for batch in batches:
            hits = [(i, b, s) for t, b, s in zip(*(batch.column(c).to_pylist() for c in ("tokens", "blocked", "source")), strict=True) for i in matches(t)]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*hits, strict=True), (pa.int32(), pa.bool_(), pa.string()), strict=True)], names=["rule", "blocked", "source"])

    counted = rows.mapInArrow(trimmed(run), "rule int, blocked boolean, source string").groupBy("rule").agg(
        F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("hits"), F.count_distinct(F.when(F.col("blocked"), F.coalesce("source", F.lit("")))).alias("sources")
    )
    good = [candidates[r["rule"]] for r in counted.collect() if r["hits"] >= least and r["hits"] >= options.min_confidence * r["n"] and r["sources"] >= options.sources]
    out: list[tuple[str, ...]] = []
    for c in sorted(good, key=lambda c: (len(c), c)):
        if not any(set(c).issuperset(x) for x in out):  # a part of it is a rule already
            out.append(c)
    return out


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], options: Options = Options(), labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), matched (the mined combination) of every row.

    labels (url, blocked) are what to learn from; without them, the pages that a listed rule judges: those it blocks against those it
    allows. A mined rule then speaks for several listed ones: where all that is listed of a host is blocked, say, the host is. Pages that no
    listed rule fits are blocked if a mined combination matches, else allowed. Null, empty and odd urls have no tokens and are allowed;
    urls of any length are read whole; repeated rows repeat; an empty table gives none; extra columns don't matter.
    """
    bounded(pages.sparkSession)
    rule, verdict = listed(rules)
    found = split_urls(pages, id_col, url_col).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), tokens().alias("tokens"))
    if labels is None:
        learn = found.where("said is not null").select("tokens", (F.col("said") == "block").alias("blocked"), F.col("rule").alias("source"))
    else:
        learn, options = labelled_tokens(labels), replace(options, sources=1)
    rules_ = mined(learn, options)
    matches = matcher(rules_)

    def run(batches):
        for batch in batches:
            matched = [None if said or not (i := matches(own)) else " & ".join(sorted(rules_[i[0]])) for said, own in zip(batch.column("said").to_pylist(), batch.column("tokens").to_pylist(), strict=True)]
            verdicts = [s or ("block" if m else "allow") for s, m in zip(batch.column("said").to_pylist(), matched, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(matched, pa.string())], names=["page_id", "host", "path", "rule", "verdict", "matched"])

    return found.mapInArrow(trimmed(run), "page_id long, host string, path string, rule string, verdict string, matched string")


def labelled_tokens(labels: DataFrame) -> DataFrame:
    """tokens, blocked, source (null) from (url, blocked)."""
    own = labels.select(F.coalesce(labels["url"].cast("string"), F.lit("")).alias("u"), F.coalesce(labels["blocked"].cast("boolean"), F.lit(False)).alias("blocked"))
    host, path = parts(F.col("u"))
    return own.select(host.alias("host"), path.alias("path"), "blocked").select(tokens().alias("tokens"), "blocked", F.lit(None).cast("string").alias("source"))
