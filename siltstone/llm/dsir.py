"""Quality by importance resampling (operator 2).

Two hashed n-gram models (words and word pairs in ``buckets`` buckets, added-count smoothing) are counted: one over the
target texts, one over all raw texts. A document's log importance weight is the sum over its n-grams of the log ratio of
both models. Gumbel top-k samples without replacement: each key is log weight plus Gumbel noise drawn from a hash of
(seed, id), and the ceil(fraction * rows) largest keys stay, with ties at the k-th key.

The target model is fitted on at most ``target_rows`` labelled rows (smallest id hashes first); raw counts cover all rows.
The k-th key is found by counting keys in ever narrower bins, so no task and not the driver sees all of them.

Defined cases: a null or empty text has weight 0; repeated rows get equal keys, and are all in or all out; without target
rows all weights are 0 and the sample is uniform; null ids draw the noise of a null; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Cache, bounded_batches, kept, map_column, written


@dataclass(frozen=True)
class Params:
    buckets: int = 10_000
    target_rows: int = 20_000
    smoothing: float = 1.0
    fraction: float = 0.8
    seed: int = 17
    bins: int = 4096


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def buckets_of(text: str | None, memo: Cache, buckets: int) -> np.ndarray:
    """Bucket numbers of the text's words and adjacent word pairs."""
    words = text.lower().split() if text else []
    one = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ one[1:]
    two = (two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate([one, two]) >> np.uint64(17)) % np.uint64(buckets)


def memo() -> Cache:
    return kept(("dsir",), lambda: Cache(word_hash))


def bucket_counts(docs: DataFrame, ids: set[int], params: Params, doc_id: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(raw, target) n-gram counts by bucket. Each task sums its rows; what reaches the driver is one row for each bucket."""
    buckets = params.buckets
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        words, target = memo(), shared.value
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = buckets_of(t, words, buckets)
                np.add.at(raw, b, 1)
                if i in target:
                    np.add.at(good, b, 1)
        some = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "target"])

    src = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    rows = src.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for b, r, g in rows:
        raw[b], good[b] = r, g
    return raw, good


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    a = np.log(target + smoothing) - math.log(target.sum() + smoothing * len(raw))
    return a - (np.log(raw + smoothing) - math.log(raw.sum() + smoothing * len(raw)))


def kth_largest(keys: DataFrame, key: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest of a column of finite doubles, by counts in narrowing bins; None if there are fewer."""
    low, high, n = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if k <= 0 or n < k:
        return None
    while low < high:
        width = (high - low) / bins
        if not width or low + width == low or high - width == high:
            break
        inside = keys.where(F.col(key).between(low, high))
        at = F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1))
        above = keys.where(F.col(key) > high).count()
        counts = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r.bin):
            if above + r.n >= k:
                low, high = r.lo, r.hi
                break
            above += r.n
        if r.n <= bins:
            rest = sorted((x[0] for x in keys.where(F.col(key).between(low, high)).select(key).collect()), reverse=True)
            return rest[k - above - 1]
    return low


def importance(docs: DataFrame, target: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_ngrams, log_weight, gumbel_key. ``target`` has the ids of target texts."""
    spark = bounded_batches(docs.sparkSession)
    ids = {r.id for r in target.select(F.col(doc_id).cast("long").alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(params.target_rows).collect()}
    raw, good = bucket_counts(docs, ids, params, doc_id, text)
    shared = spark.sparkContext.broadcast(log_ratios(raw, good, params.smoothing))
    buckets = params.buckets

    def make():
        words, ratio = memo(), shared.value

        def work(texts: list) -> pa.Array:
            n, total = [], []
            for t in texts:
                b = buckets_of(t, words, buckets)
                n.append(len(b))
                total.append(float(ratio[b].sum()))
            return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(total, pa.float64())], ["n_ngrams", "log_weight"])

        return work

    score = map_column(make, "struct<n_ngrams:bigint,log_weight:double>")
    uniform = (F.pmod(F.xxhash64(F.lit(params.seed), "doc_id"), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), score(F.col(text).cast("string")).alias("s"))
    return src.select("doc_id", "s.n_ngrams", "s.log_weight").withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))


def resample(docs: DataFrame, target: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The sampled rows of ``importance``: the ceil(fraction * rows) largest Gumbel keys."""
    keys = written(importance(docs, target, params, doc_id, text), "dsir")
    n = keys.count()
    least = kth_largest(keys, "gumbel_key", math.ceil(params.fraction * n), params.bins) if n else None
    return keys.where(F.col("gumbel_key") >= least) if least is not None else keys.where("false")
