"""Benchmark decontamination by a BM25 inverted index with block-max WAND (operator 3).

The test items are indexed: postings by term in item order, cut into blocks of ``block_items`` items, each with the largest
impact in it. Impacts are BM25 weights divided by the item's score for its own text, so 1 means that all of an item's
weight is met. Every text is a row of overlapping passages (windows of twice the longest item, a stride of once), and each
passage is a query. Terms that are common to many items and together stay below half the threshold are non-essential: a
passage whose other terms can't reach the rest is skipped. Only blocks that essential terms stand in are looked at: their
maxima, with the most that the passage's common terms can add, leave out all blocks that can't reach the threshold, so the long
posting lists are never gone through. In what is left the terms' cursors go by item: the pivot is the first item at which the maxima of the terms up to
there reach the threshold, terms before it seek to it, and only items that all of them have reached are scored. All items at
or above the threshold are retrieved.

Retrieved items are verified by word shingles of ``shingle`` words: at least ``overlap`` of the item's must stand in the
passage, and at least half of its question's and half of its answer's. An item's answer is what follows its last question
mark, or else its last sentence, or else its second half.

The items are indexed in shards of at most about ``shard_items``, which bounds what is broadcast; every text meets every
shard. Document frequencies, mean length and the windows' size are those of all items, so shards change no score.

Defined cases: null or empty texts and items match nothing; items of fewer words than a shingle are one shingle of their own length; repeated rows
and items are reported each; ties don't matter, since all above the threshold are kept; an empty benchmark finds no leaks;
extra columns are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_batches, boxed, map_column, map_rows, unboxed, words_of, written


@dataclass(frozen=True)
class Params:
    threshold: float = 0.6
    overlap: float = 0.8
    part_overlap: float = 0.5
    shingle: int = 5
    k1: float = 1.2
    b: float = 0.75
    block_items: int = 4
    shard_items: int = 20_000


KIND = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,first_word:bigint,last_word:bigint>>"
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def question_and_answer(text: str) -> tuple[str, str]:
    head, mark, tail = text.rpartition("?")
    if mark and words_of(head) and words_of(tail):
        return head, tail
    parts = [p for p in SENTENCE.split(text) if words_of(p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2 :])


def shingles(words: list[bytes], size: int) -> list[bytes]:
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def item_parts(text: str, size: int) -> tuple[int, set[bytes], set[bytes], set[bytes]]:
    """(shingle size, the item's shingles, those that begin in its question, those that end in its answer).

    Shingles go over the border, so that an answer of a word or two is judged with the words before it; an item of fewer
    words than a shingle is one shingle of its own length.
    """
    words, head = words_of(text), len(words_of(question_and_answer(text)[0]))
    size = min(size, len(words))
    every = shingles(words, size)
    return size, set(every), set(every[: max(1, head - size + 1)]), set(every[max(0, min(len(every) - 1, head - size + 1)) :])


@dataclass(frozen=True)
class Stats:
    """Of all items that have words: how many, their mean and largest length, and of each term the items that have it."""

    n: int
    mean: float
    longest: int
    df: dict[bytes, int]

    @staticmethod
    def of(lists: list[list[bytes]]) -> Stats:
        lens = [len(w) for w in lists]
        return Stats(len(lens), sum(lens) / max(1, len(lens)), max(lens, default=1), Counter(t for w in lists for t in set(w)))


class Index:
    def __init__(self, items: list[tuple[int, str]], params: Params, stats: Stats | None = None):
        self.p = params
        kept_items = [(i, t, w) for i, t in items if (w := words_of(t))]
        stats = stats or Stats.of([w for _, _, w in kept_items])
        self.ids = [i for i, _, _ in kept_items]
        self.parts = [item_parts(t, params.shingle) for _, t, _ in kept_items]
        self.stride, df = stats.longest, stats.df
        own_terms = {t for _, _, w in kept_items for t in w}
        self.vocab = {t: k for k, t in enumerate(sorted(own_terms, key=lambda t: (-df[t], t)))}  # most common first
        weight = {t: math.log(1 + (stats.n - df[t] + 0.5) / (df[t] + 0.5)) for t in own_terms}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocab]
        for item, (_, _, w) in enumerate(kept_items):
            own = {t: weight[t] * c * (params.k1 + 1) / (c + params.k1 * (1 - params.b + params.b * len(w) / stats.mean)) for t, c in Counter(w).items()}
            total = sum(own.values())
            for t, s in own.items():
                postings[self.vocab[t]].append((item, s / total))
        self.items = [[i for i, _ in p] for p in postings]
        self.impacts = [[s for _, s in p] for p in postings]
        self.blocks, self.maxima = [], []
        for i, s in zip(self.items, self.impacts, strict=True):
            b, first = np.unique(np.array(i) // params.block_items, return_index=True)
            self.blocks.append(b)
            self.maxima.append(np.maximum.reduceat(np.array(s), first))
        upper = np.array([max(s) for s in self.impacts] + [0.0])  # the last is for words of no item
        common = np.cumsum(upper[:-1]) <= params.threshold / 2
        self.rest = float(upper[:-1][common].sum())
        self.common = np.append(np.where(common, upper[:-1], 0.0), 0.0)
        upper[:-1][common] = 0.0
        self.essential = upper

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All (item, score) at or above the threshold for a passage's distinct terms."""
        least = self.p.threshold - 1e-9
        essential = terms[self.essential[terms] > 0]
        if not len(essential):
            return []
        essential = essential.tolist()
        bound = np.bincount(np.concatenate([self.blocks[t] for t in essential]), np.concatenate([self.maxima[t] for t in essential]))
        out = []
        for block in np.flatnonzero(bound >= least - self.common[terms].sum()).tolist():  # common terms alone reach no item
            out += self.within(block, terms.tolist(), least)
        return out

    def within(self, block: int, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All (item, score) at or above ``least`` in a block, by cursors and pivots."""
        end = (block + 1) * self.p.block_items
        cursors = []  # [item, term, place, the term's largest impact in the block]
        for t in terms:
            at = bisect_left(self.items[t], block * self.p.block_items)
            if at < len(self.items[t]) and self.items[t][at] < end:
                cursors.append([self.items[t][at], t, at, float(self.maxima[t][np.searchsorted(self.blocks[t], block)])])
        out = []
        while cursors:
            cursors.sort()
            reach, pivot = 0.0, None
            for c in cursors:
                reach += c[3]
                if reach >= least:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                here = [c for c in cursors if c[0] == pivot]
                score = sum(self.impacts[c[1]][c[2]] for c in here)
                if score >= least:
                    out.append((pivot, score))
            else:
                here = [c for c in cursors if c[0] < pivot]
            for c in here:
                items = self.items[c[1]]
                c[2] = bisect_left(items, pivot if c[0] < pivot else pivot + 1, c[2])
                c[0] = items[c[2]] if c[2] < len(items) else end
            cursors = [c for c in cursors if c[0] < end]
        return out

    def leaks(self, text: str | None) -> list[dict]:
        words = words_of(text)
        if not words or not self.ids:
            return []
        terms = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        sums = np.concatenate([[0.0], np.cumsum(self.essential[terms])])
        starts = np.arange(0, len(words), self.stride)
        ends = np.minimum(starts + 2 * self.stride, len(words))
        need = self.p.threshold - self.rest - 1e-9
        found: dict[int, dict] = {}
        for a, b in zip(*(x[sums[ends] - sums[starts] >= need].tolist() for x in (starts, ends)), strict=True):
            distinct = np.unique(terms[a:b])
            distinct = distinct[distinct >= 0]
            if not len(distinct):
                continue
            hits = self.retrieve(distinct)
            if not hits:
                continue
            places: dict[int, dict[bytes, list[int]]] = {}
            for item, score in hits:
                size, whole, question, answer = self.parts[item]
                if size not in places:
                    at = places[size] = {}
                    for i, x in enumerate(shingles(words[a:b], size), a):
                        at.setdefault(x, []).append(i)
                at = places[size]
                share = lambda part: len(part & at.keys()) / len(part)
                q, r = share(question), share(answer)
                if share(whole) >= self.p.overlap and min(q, r) >= self.p.part_overlap:
                    seen = [i for x in whole & at.keys() for i in at[x]]
                    one = {"item_id": self.ids[item], "score": score, "question_overlap": q, "answer_overlap": r, "first_word": min(seen), "last_word": max(seen) + size - 1}
                    if item not in found or (score, -one["first_word"]) > (found[item]["score"], -found[item]["first_word"]):
                        found[item] = one
        return [found[i] for i in sorted(found)]


def indexes(benchmark: DataFrame, params: Params = Params(), item_id: str = "item_id", text: str = "text") -> Iterator[Index]:
    """One index for each shard of the benchmark, one at a time."""
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).where("t is not null")
    shards = max(1, -(-items.count() // params.shard_items))
    shard = F.pmod(F.xxhash64("t"), F.lit(shards))
    if shards == 1:
        yield Index([(r.id, r.t) for r in items.orderBy("id", "t").collect()], params)
        return
    words = map_rows(items.select("t", shard.alias("shard")), word_rows, "shard long, n long, term binary")
    n, mean, longest = words.where("n > 0").agg(F.count("n"), F.avg("n"), F.max("n")).first()
    df = written(words.where("term is not null").groupBy("term").agg(F.count("*").alias("df"), F.collect_set("shard").alias("shards")), "term-counts")
    for s in range(shards):
        counts = dict((bytes(r.term), r.df) for r in df.where(F.array_contains("shards", s)).select("term", "df").collect())  # terms of one shard's items
        yield Index([(r.id, r.t) for r in items.where(shard == s).orderBy("id", "t").collect()], params, Stats(n, float(mean or 0), longest or 1, counts))


def word_rows():
    """Of each item a row with its number of words and a row for each distinct one."""

    def work(batch: pa.RecordBatch):
        rows = []
        for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(t)
            rows += [(s, len(words), None), *((s, None, w) for w in set(words))]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "n", "term"])

    return work


def leak_column(text: Column, index: Index, spark) -> Column:
    shared = spark.sparkContext.broadcast(index)  # bounded by shard_items
    kind = pa.list_(
        pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    )

    def make():
        index = shared.value
        return lambda texts: pa.array([index.leaks(t) for t in texts], kind)

    return map_column(make, KIND)(text.cast("string"))


def leaks(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each text and item it leaks: doc_id, item_id, score, overlaps, first and last word of the match."""
    spark = bounded_batches(docs.sparkSession)
    found = None
    for index in indexes(benchmark, params):
        part = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.explode(leak_column(F.col(text), index, spark)).alias("leak"))
        found = part if found is None else found.unionByName(part)
    return found.select("doc_id", "leak.*")


def clean(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), text: str = "text") -> DataFrame:
    """The documents, all columns kept, that leak no item."""
    spark = bounded_batches(docs.sparkSession)
    rows = boxed(docs, text=F.col(text).cast("string"))
    for index in indexes(benchmark, params):
        rows = rows.where(F.size(leak_column(F.col("text"), index, spark)) == 0)
    return unboxed(rows, docs)
