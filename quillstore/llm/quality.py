"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every document gets counts; per language and source, a sketch of each ratio's distribution gives its threshold; a join brings the
thresholds back to the documents. A sketch is a histogram of thousandths: sketches merge by adding counts, in any order with the same
result, and quantiles are exact to a thousandth. Groups of few documents use the merged sketch of their language, then that of all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import attached, fresh
from .text import kept as written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """Fixed limits of the base rules, and how far above its group's third quartile a document's ratio may lie.

    That is the largest of: `reach` times the quartiles' distance; for each ratio, so many times the distance from the third quartile to a
    high quantile (in hundredths) of the group; and a least margin (in thousandths), as most groups have none of a ratio. The high quantile
    is such that what a clean corpus has in its tail, repeated lines say, widens the fence, and what is rarer than the tail doesn't.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    reach: int = 3
    min_rows: int = 50
    #: Ratio, high quantile, times, least margin; word length counts in hundredths of a letter.
    margins: tuple[tuple[str, int, int, int], ...] = (("symbol", 75, 3, 30), ("dup_line", 99, 2, 50), ("repeat", 99, 2, 20), ("length", 90, 4, 100))

    @property
    def ratios(self) -> list[str]:
        return [m[0] for m in self.margins]


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f's lambdas use it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _repeat_words(words: Column) -> Column:
    """How many words lie in windows of five words that occur twice or more in the text. Windows are compared by 64-bit hashes."""

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)) | F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]).otherwise(False))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        steps = bind(bind(pairs, twice), lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) < WINDOW, 0).otherwise(
        bind(
            bind(F.transform(words, lambda w: F.xxhash64(w)), windows),
            lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(covered(found)),
        )
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, key and the counts of every row. A null text has no words and no lines. Rows of equal inputs have equal keys."""
    inputs = [docs[id_col].cast("long"), docs[lang_col], docs[source_col], docs[text_col]]
    one = docs.select(inputs[0].alias("doc_id"), inputs[1].alias("lang"), inputs[2].alias("source"), F.coalesce(inputs[3], F.lit("")).alias("text"), F.xxhash64(*inputs).alias("key"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = one.select(
        "doc_id",
        "lang",
        "source",
        "key",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        bind(F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeat"))).alias("words"),
    )
    return split.select(
        "doc_id",
        "lang",
        "source",
        "key",
        F.col("words.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.dup").cast("long").alias("n_dup_lines"),
        F.col("words.repeat").cast("long").alias("n_repeat_words"),
        F.col("lines.n").cast("long").alias("n_lines"),
    )


def _base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def _ratios(rules: Rules) -> Column:
    """(ratio, bucket) of a document: whole thousandths, so that every engine gives the same."""
    share = {
        "symbol": F.expr("1000 * n_symbols div greatest(word_chars, 1)"),
        "dup_line": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
        "repeat": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
        "length": F.expr("least(100 * word_chars div greatest(n_words, 1), 10000L)"),
    }
    return F.array(*(F.struct(F.lit(name).alias("ratio"), share[name].alias("bucket")) for name in rules.ratios))


def sketches(found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """lang, source, ratio, bucket, n: the sketches of all groups, of documents that pass the base rules. Summed before the shuffle."""
    each = found.where(~_base_failed(rules)).select("lang", "source", F.explode(_ratios(rules)).alias("x"))
    return each.groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """lang, source and one fence for each ratio, by the most particular sketch that has min_rows documents."""
    of = lambda k: F.create_map(*(F.lit(x) for m in rules.margins for x in (m[0], m[k])))[F.col("ratio")].cast("long")

    def level(*keys: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
        below = F.expr(f"sum(n) over (partition by {', '.join([*keys, 'ratio'])} order by bucket)")
        total = F.expr(f"sum(n) over (partition by {', '.join([*keys, 'ratio'])})")
        ranked = merged.select(*keys, "ratio", "bucket", below.alias("upto"), total.alias("total"))
        quantile = lambda hundredths: F.min(F.when(100 * F.col("upto") >= hundredths * F.col("total"), F.col("bucket")))
        each = ranked.groupBy(*keys, "ratio").agg(quantile(F.lit(25)).alias("q1"), quantile(F.lit(75)).alias("q3"), quantile(of(1)).alias("high"), F.max("total").alias("rows"))
        fence = F.col("q3") + F.greatest(rules.reach * (F.col("q3") - F.col("q1")), of(2) * (F.col("high") - F.col("q3")), of(3))
        wide = each.groupBy(*keys).agg(F.max("rows").alias("rows"), *(F.max(F.when(F.col("ratio") == name, fence)).alias(name) for name in rules.ratios))
        return wide

    names = rules.ratios
    own = level("lang", "source").alias("o")
    lang = level("lang").withColumnsRenamed({n: f"{n}_l" for n in [*names, "rows"]}).withColumnRenamed("lang", "lang_l").alias("l")
    every = level().withColumnsRenamed({n: f"{n}_a" for n in names}).drop("rows").withColumn("all_a", F.lit(1))
    joined = own.join(lang, F.col("o.lang").eqNullSafe(F.col("lang_l")), "left").withColumn("all_o", F.lit(1)).join(every, F.col("all_o") == F.col("all_a"), "left")
    pick = lambda n: F.when(F.col("o.rows") >= rules.min_rows, F.col(f"o.{n}")).when(F.col("rows_l") >= rules.min_rows, F.col(f"{n}_l")).otherwise(F.col(f"{n}_a"))
    return joined.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), *(pick(n).alias(n) for n in names))


def judged(docs: DataFrame, rules: Rules = Rules(), **columns: str) -> DataFrame:
    """verdicts() and each row's key."""
    found = written(features(docs, **columns))
    limits = fences(sketches(found, rules), rules).withColumnsRenamed({"lang": "g_lang", "source": "g_source"} | {n: f"max_{n}" for n in rules.ratios})
    joined = found.join(limits, found["lang"].eqNullSafe(F.col("g_lang")) & found["source"].eqNullSafe(F.col("g_source")), "left")
    within = F.forall(F.arrays_zip(_ratios(rules).alias("r"), F.array(*(F.col(f"max_{n}") for n in rules.ratios)).alias("m")), lambda x: x["r"]["bucket"] <= x["m"])
    failed = _base_failed(rules)
    return joined.select("key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(within, F.lit(False))).alias("kept"))


def verdicts(docs: DataFrame, rules: Rules = Rules(), **columns: str) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row; repeated rows repeat, null doc_id, lang and source are values of their own.

    Empty tables give empty results; texts of any length are read whole; other columns don't matter; texts without words fail the base rules. The counts are written once, as both the sketches and the
    join read them. The join is by (lang, source): one side has a row for each group, and Spark broadcasts it only if it is small.
    """
    return judged(docs, rules, **columns).drop("key")


def good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs, with all columns whatever their names, that verdicts() keeps. Only the keys of rejected rows are joined.

    Null and empty texts go, as they fail the base rules; equal rows stay or go together; no rows give none.
    """
    key, id_ = fresh(docs, "bad_key"), fresh(docs, "bad_id")
    bad = written(judged(docs, rules).where(~F.col("kept")).select(F.col("key").alias(key), F.coalesce("doc_id", F.lit(-1)).alias(id_)).distinct())
    keyed = docs.withColumns({key: F.xxhash64(docs["doc_id"].cast("long"), docs["lang"], docs["source"], docs["text"]), id_: F.coalesce(docs["doc_id"].cast("long"), F.lit(-1))})
    return attached(keyed, bad, [key, id_], "left_anti").drop(key, id_)


#: The rows of verdicts() with default rules over documents.
ORACLE = r"""
with d as (select doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
starts as (select doc_id, unnest(range(1, cast(len(words) as bigint) - 3)) as i, words from w where len(words) >= 5),
win as (select doc_id, i, array_to_string(words[i:i+4], ' ') as g from starts),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n > 1),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from rep) group by 1),
f as (select w.doc_id, lang, source, cast(len(words) as bigint) as n_words,
  cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(cov.n, 0) as bigint) as n_repeat_words,
  cast(len(lines) as bigint) as n_lines from w left join cov on cov.doc_id = w.doc_id),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f),
r as (select *, 1000 * n_symbols // greatest(word_chars, 1) as symbol, 1000 * n_dup_lines // greatest(n_lines, 1) as dup_line,
  1000 * n_repeat_words // greatest(n_words, 1) as repeat, least(100 * word_chars // greatest(n_words, 1), 10000) as length from b),
x as (select lang, source, 'symbol' as ratio, 75 as high, 3 as times, 30 as margin, symbol as bucket from r where not base_failed union all
  select lang, source, 'dup_line', 99, 2, 50, dup_line from r where not base_failed union all
  select lang, source, 'repeat', 99, 2, 20, repeat from r where not base_failed union all
  select lang, source, 'length', 90, 4, 100, length from r where not base_failed),
l as (select 2 as level, lang, source, * exclude (lang, source) from x union all select 1, lang, null, * exclude (lang, source) from x union all select 0, null, null, * exclude (lang, source) from x),
h as (select level, lang, source, ratio, high, times, margin, bucket, count(*) as n from l group by all),
u as (select *, sum(n) over (partition by level, lang, source, ratio order by bucket) as upto, sum(n) over (partition by level, lang, source, ratio) as total from h),
q as (select level, lang, source, ratio, times, margin, max(total) as n, min(case when 100 * upto >= 25 * total then bucket end) as q1,
  min(case when 100 * upto >= 75 * total then bucket end) as q3, min(case when 100 * upto >= high * total then bucket end) as qh from u group by all),
t as (select *, q3 + greatest(3 * (q3 - q1), times * (qh - q3), margin) as fence from q),
p as (select o.lang, o.source, o.ratio, case when o.n >= 50 then o.fence when g.n >= 50 then g.fence else a.fence end as fence
  from t o join t g on g.level = 1 and g.lang is not distinct from o.lang and g.ratio = o.ratio join t a on a.level = 0 and a.ratio = o.ratio where o.level = 2),
m as (select lang, source, max(case when ratio = 'symbol' then fence end) as symbol, max(case when ratio = 'dup_line' then fence end) as dup_line,
  max(case when ratio = 'repeat' then fence end) as repeat, max(case when ratio = 'length' then fence end) as length from p group by 1, 2)
select r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
  not r.base_failed and coalesce(r.symbol <= m.symbol and r.dup_line <= m.dup_line and r.repeat <= m.repeat and r.length <= m.length, false) as kept
from r left join m on m.lang is not distinct from r.lang and m.source is not distinct from r.source
"""
