"""Toxicity by cumulative-link ordinal regression over sparse text features (operator 4).

P(grade >= k | x) = sigmoid(w.x - cut_k): one weight vector is shared by all ordered cuts. Features are the distinct
lower-cased words of a text and the words' beginnings, hashed. The fit runs on a bounded sample of labelled rows (``sample_rows``, smallest hashes of
their ids first) by accelerated proximal gradient steps with an L1 penalty, so that words without evidence get weight 0.

Labels are 0/1; rows labelled 1 are graded 1..grades-1 by quantiles of their number of distinct words that are indicative
(smoothed log-odds of at least ``indicative``). The score is the expected severity, the sum of P(grade >= k).

Defined cases: a null or empty text has no features and so the intercept's severity; without labelled rows of both kinds
every severity is 0; repeated rows and ids are scored each; extra columns are kept by ``with_severity``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Cache, bounded_batches, forget, kept, map_column, words_of

#: Lengths in bytes of the word beginnings that are features too.
BEGINNINGS = (4, 5)
#: Words in a generation of the memo of the sample's features; a word takes about 700 bytes.
MEMO = 50_000


@dataclass(frozen=True)
class Params:
    bits: int = 20
    grades: int = 3
    sample_rows: int = 6000
    least_docs: int = 5
    indicative: float = 2.0
    l1: float = 2e-4
    steps: int = 250
    decision: float = 0.5


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    cuts: tuple[float, ...]
    bits: int

    def tails(self, logit: float) -> list[float]:
        return [1.0 / (1.0 + float(np.exp(min(50.0, max(-50.0, c - logit))))) for c in self.cuts]


def word_features(word: bytes, bits: int) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings; the latter catch inflected forms."""
    forms = [word, *(b"^" + word[:k] for k in BEGINNINGS if len(word) >= k)]
    return tuple(xxhash.xxh64_intdigest(f) >> (64 - bits) for f in forms)


def features(text: str | None, memo: dict) -> list[int]:
    found: set[int] = set()
    for hashes in map(memo.__getitem__, set(words_of(text))):
        found.update(hashes)
    return sorted(found)


def hasher(bits: int) -> Cache:
    return Cache(lambda w: word_features(w, bits), MEMO)


def training_rows(docs: DataFrame, labels: DataFrame, params: Params, doc_id: str, text: str, label: str) -> list[tuple[int, np.ndarray]]:
    """(label, features) of the sample; bounded by ``sample_rows``. The features come as one array, not as objects."""
    spark = docs.sparkSession
    chosen = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(doc_id).cast("long").alias("id"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(params.sample_rows)
        .collect()
    )
    if not chosen:
        return []
    ids = spark.createDataFrame(chosen, "id long, y int")
    bits = params.bits

    def make():
        forget()  # the memos of stages before
        memo = hasher(bits)
        return lambda texts: pa.array([features(t, memo) for t in texts], pa.list_(pa.int32()))

    # the sample is bounded by sample_rows, so it is broadcast
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    found = texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.first("y").alias("y"), F.max("t").alias("t"))
    got = found.select("id", "y", map_column(make, "array<int>")(F.col("t")).alias("f")).orderBy("id").toArrow().combine_chunks()
    if not got.num_rows:
        return []
    lists = got.column("f").combine_chunks()
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return list(zip(got.column("y").to_pylist(), np.split(lists.flatten().to_numpy(), ends[:-1]), strict=True))


def fit(rows: list[tuple[int, list[int] | np.ndarray]], params: Params) -> Model:
    y = np.array([r[0] for r in rows], dtype=np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Model({}, (50.0,) * (params.grades - 1), params.bits)
    lens = np.array([len(r[1]) for r in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), lens)
    col = np.concatenate([np.asarray(r[1], dtype=np.int32) for r in rows]) if lens.sum() else np.zeros(0, np.int32)
    names, col, seen = np.unique(col, return_inverse=True, return_counts=True)
    keep = seen >= params.least_docs
    renumber = np.cumsum(keep) - 1
    sel = keep[col]
    row, col, names = row[sel], renumber[col[sel]].astype(np.int32), names[keep]
    d, n = len(names), len(rows)
    pos = np.bincount(col, weights=(y == 1)[row], minlength=d)
    neg = np.bincount(col, weights=(y == 0)[row], minlength=d)
    n1 = int((y == 1).sum())
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n - n1 + 1))
    hits = np.bincount(row, weights=(odds >= params.indicative)[col], minlength=n)
    grade = np.zeros(n, dtype=np.int64)
    quantiles = np.quantile(hits[y == 1], np.arange(1, params.grades - 1) / (params.grades - 1))
    grade[y == 1] = 1 + np.searchsorted(quantiles, hits[y == 1], side="left")
    above = (grade[None, :] >= np.arange(1, params.grades)[:, None]).astype(float)
    # cut_k = cut_1 + sum of squares keeps the cuts in order
    w, base, gap = np.zeros(d), -np.log((n1 + 1) / (n - n1 + 1)), np.ones(params.grades - 2)
    z, zb, zg, t = w.copy(), base, gap.copy(), 1.0
    rate = 4.0 / max(1.0, float(np.median(lens)) ** 0.5)
    for _ in range(params.steps):
        logit = np.bincount(row, weights=z[col], minlength=n)
        cuts = zb + np.concatenate([[0.0], np.cumsum(zg**2)])
        err = (1.0 / (1.0 + np.exp(np.clip(cuts[:, None] - logit[None, :], -50, 50))) - above) / n
        total = err.sum(0)
        step = z - rate * np.bincount(col, weights=total[row], minlength=d)
        w_new = np.sign(step) * np.maximum(np.abs(step) - rate * params.l1, 0.0)
        per = err.sum(1)
        b_new = zb + rate * per.sum()
        g_new = zg + rate * 2 * zg * np.cumsum(per[::-1])[::-1][1:]
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        m = (t - 1) / t_new
        z, zb, zg = w_new + m * (w_new - w), b_new + m * (b_new - base), g_new + m * (g_new - gap)
        w, base, gap, t = w_new, b_new, g_new, t_new
    cuts = base + np.concatenate([[0.0], np.cumsum(gap**2)])
    used = np.flatnonzero(w)
    return Model({int(names[i]): float(w[i]) for i in used}, tuple(map(float, cuts)), params.bits)


def train(docs: DataFrame, labels: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    bounded_batches(docs.sparkSession)
    return fit(training_rows(docs, labels, params, doc_id, text, label), params)


def severity(text: Column, model: Model, params: Params = Params()) -> Column:
    """struct(expected_severity double, grade int, toxic boolean) of a text column."""
    kind = "struct<expected_severity:double,grade:int,toxic:boolean>"
    weights, bits, decision = model.weights, model.bits, params.decision

    def make():
        memo = kept(("toxicity", hash(model.cuts), len(weights)), lambda: Cache(lambda w: tuple(h for h in word_features(w, bits) if h in weights), 100_000))

        def work(texts: list) -> pa.Array:
            out = []
            for t in texts:
                hit: set[int] = set()
                for hashes in filter(None, map(memo.__getitem__, words_of(t))):
                    hit.update(hashes)
                tails = model.tails(sum(weights[h] for h in sorted(hit)))
                out.append({"expected_severity": sum(tails), "grade": sum(p >= decision for p in tails), "toxic": tails[0] >= decision})
            return pa.array(out, pa.struct([("expected_severity", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())]))

        return work

    return map_column(make, kind)(text)


def with_severity(docs: DataFrame, model: Model, name: str = "severity", text: str = "text", params: Params = Params()) -> DataFrame:
    """The documents, all columns kept, with the struct of ``severity`` as column ``name``."""
    return docs.withColumn(name, severity(F.col(text).cast("string"), model, params))
