"""Divergence of sources within a language (operator 13): inclusion-exclusion over supports.

Each language keeps the terms that at least ``min_docs`` of its documents hold, V of them. A group (lang, source), and each
language, gives a kept term of c occurrences the weight p = 1 + floor(10^9 * (c + 1) / (N + V)), N being the group's sum of c. Of
two groups, f(p, q) = floor((p - q)^2 / q) is summed over all kept terms without going through them for each pair:

1. Counts. One pass counts terms of a group within a task; one shuffle by (lang, term) adds them up, finds in how many
   documents of the language a term stands, and writes the postings (lang, source, term, n).
2. One-sided terms. A group's histogram of counts prices its whole support against the weight q0 that another group gives to
   every term it lacks; groups of equal q0 share a price. The other direction likewise.
3. Overlaps. Postings joined by term correct what the prices say of terms that both have:
   f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), summed for each pair of groups before the shuffle.
4. Both zero. All other kept terms cost f(p0, q0) each, counted by V and the sizes of the supports.

All arithmetic is in whole numbers; sums of products go through decimals or two halves, so that nothing overflows.

Defined cases: null text, lang and source count as ''; a group without terms has N = 0; a language without kept terms has V = 0
and distances of 0; a source alone in its language has no pairs; repeated rows are documents of their own; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_batches, few, forget, written

UNIT = 1_000_000_000

#: Lower-cases A-Z, keeps a-z and all bytes from 0x80, and turns every other byte into a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Params:
    min_docs: int = 3  # documents of a language that hold a kept term
    top_terms: int = 200
    salts: int = 32  # parts in which a group's terms are ranked before they are ranked together
    task_terms: int = 300_000  # counts that a task holds before it sends them on


def weight(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / (total + v))."""
    above = F.lit(UNIT).cast("decimal(12,0)") * (n + 1).cast("decimal(19,0)")
    return F.call_function("div", above, (total + v).cast("decimal(20,0)")) + 1


def cost(p: Column, q: Column) -> Column:
    """f(p, q): weights are at most 10^9 + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame, p: Params) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up within a task."""
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    names = ["lang", "source", "term", "n", "docs"]

    def sent(held) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for (lang, source), (n, docs_) in held.items():
            cols[0] += [lang] * len(n)
            cols[1] += [source] * len(n)
            cols[2] += [w.decode() for w in n]
            cols[3] += n.values()
            cols[4] += [docs_[w] for w in n]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches):
        forget()
        held, size = defaultdict(lambda: (Counter(), Counter())), 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode().translate(TERM_BYTES).split()
                if words:
                    n, docs_ = held[lang, source]
                    size -= len(n)
                    n.update(words)
                    docs_.update(set(words))
                    size += len(n)
                    if size >= p.task_terms:
                        yield sent(held)
                        held.clear()
                        size = 0
        if held:
            yield sent(held)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def postings(rows: DataFrame, p: Params) -> DataFrame:
    """(lang, source, term, n, total, lead) of kept terms; total is the language's count, one row of each term leads."""
    by_term = Window.partitionBy("lang", "term")
    summed = rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = summed.select("lang", "source", "term", "n", F.sum("docs").over(by_term).alias("in_docs"), F.sum("n").over(by_term).alias("total"), (F.min("source").over(by_term) == F.col("source")).alias("lead"))
    return written(every.where(F.col("in_docs") >= p.min_docs).drop("in_docs"), "postings")


def group_stats(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """(lang, source, size, support, v, lang_size, p0) of every occurring group; p0, the weight of a term it lacks, is null without
    kept terms."""
    own = posted.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("support"))
    langs = posted.groupBy("lang").agg(F.sum(F.col("lead").cast("long")).alias("v"), F.sum("n").alias("lang_size"))
    every = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(few(langs), "lang", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("size", "support", "v", "lang_size")]
    stats = every.select("lang", "source", *zero)
    return written(stats.withColumn("p0", F.when(F.col("v") > 0, weight(F.lit(0).cast("long"), F.col("size"), F.col("v")))), "groups")


def side(frame: DataFrame, mark: str, *but: str) -> DataFrame:
    return frame.select(*but, *[F.col(c).alias(mark + c) for c in frame.columns if c not in but])


def pair_values(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language."""
    p, p0, a_p, a_p0, b_p, b_p0 = (F.col(c) for c in ("p", "p0", "a_p", "a_p0", "b_p", "b_p0"))
    with_stats = few(stats.select("lang", "source", "size", "v", "p0"))
    # prices of whole supports by the histogram of counts, for each weight of absent terms that the language has
    counts = posted.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(with_stats, ["lang", "source"])
    priced = counts.select("lang", "source", "terms", weight(F.col("n"), F.col("size"), F.col("v")).alias("p"))
    absent = stats.where("p0 is not null").select("lang", "p0").distinct()
    times = lambda f: F.sum(F.col("terms").cast("decimal(18,0)") * f.cast("decimal(19,0)")).cast("decimal(38,0)")
    prices = written(priced.join(few(absent), "lang").groupBy("lang", "source", "p0").agg(times(cost(p, p0)).alias("out"), times(cost(p0, p)).alias("into")), "prices")
    # corrections of terms that both have
    both = posted.join(with_stats, ["lang", "source"]).select("lang", "term", "source", weight(F.col("n"), F.col("size"), F.col("v")).alias("p"), "p0")
    met = side(both, "a_", "lang", "term").join(side(both, "b_", "lang", "term"), ["lang", "term"]).where("a_source < b_source")
    there = cost(a_p, b_p) - cost(a_p, b_p0) - cost(a_p0, b_p) + cost(a_p0, b_p0)
    back = cost(b_p, a_p) - cost(b_p, a_p0) - cost(b_p0, a_p) + cost(b_p0, a_p0)
    rows = met.select("lang", "a_source", "b_source", there.alias("there"), back.alias("back"))
    halves = [f(c).alias(c + mark) for c in ("there", "back") for mark, f in (("_high", lambda c: F.sum(F.shiftright(c, 32))), ("_low", lambda c: F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))))]
    joint = rows.groupBy("lang", "a_source", "b_source").agg(F.count("*").alias("common"), *halves)
    whole = lambda c: (F.col(c + "_high").cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(c + "_low").cast("decimal(19,0)")).cast("decimal(38,0)")
    joint = written(joint.select("lang", "a_source", "b_source", "common", whole("there").alias("there"), whole("back").alias("back")), "overlaps")
    turned = joint.select("lang", F.col("b_source").alias("a_source"), F.col("a_source").alias("b_source"), "common", F.col("back").alias("there"))
    joint = joint.drop("back").unionByName(turned)
    # every ordered pair
    side_stats = stats.select("lang", "source", "support", "v", "p0")
    pairs = side(side_stats, "a_", "lang", "v").join(few(side(side_stats.drop("v"), "b_", "lang")), "lang").where("a_source <> b_source")
    out = prices.select("lang", F.col("source").alias("a_source"), F.col("p0").alias("b_p0"), "out")
    into = prices.select("lang", F.col("source").alias("b_source"), F.col("p0").alias("a_p0"), "into")
    every = pairs.join(few(out), ["lang", "a_source", "b_p0"], "left").join(few(into), ["lang", "b_source", "a_p0"], "left").join(joint, ["lang", "a_source", "b_source"], "left")
    none = F.lit(0).cast("decimal(38,0)")
    neither = F.col("v") - F.col("a_support") - F.col("b_support")
    value = F.coalesce("out", none) + F.coalesce("into", none) + F.coalesce("there", none) + neither.cast("decimal(18,0)") * cost(a_p0, b_p0).cast("decimal(19,0)")
    return every.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), F.when(F.col("v") > 0, value).otherwise(none).cast("long").alias("value"))


def term_values(posted: DataFrame, stats: DataFrame, p: Params) -> DataFrame:
    """(lang, source, item, value, rank): the terms of a group that it uses more than its language does, the strongest."""
    rows = posted.join(few(stats.select("lang", "source", "size", "v", "lang_size")), ["lang", "source"])
    own, all_ = weight(F.col("n"), F.col("size"), F.col("v")), weight(F.col("total"), F.col("lang_size"), F.col("v"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), own.alias("p"), all_.alias("q")).where("p > q")
    rows = rows.select("lang", "source", "item", cost(F.col("p"), F.col("q")).alias("value"), F.pmod(F.xxhash64("item"), F.lit(p.salts)).alias("salt"))
    first = Window.partitionBy("lang", "source", "salt").orderBy(F.desc("value"), "item")
    rows = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= p.top_terms).drop("salt", "rank")
    then = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(then)).where(F.col("rank") <= p.top_terms)


def audit(docs: DataFrame, params: Params = Params(), lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source of the language, part ``term`` the terms that
    tell the group from its language; by value descending, then item."""
    bounded_batches(docs.sparkSession)
    given = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))]
    docs = docs.select(*given)
    posted = postings(term_counts(docs, params), params)
    stats = group_stats(docs, posted)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(posted, stats).withColumn("rank", F.row_number().over(ranked))
    terms = term_values(posted, stats, params)
    every = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return every.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
