"""Ranked retrieval: BM25 postings, dense vectors, fusion, merging, reranking.

Queries come as tables, so a batch of questions is one job. Query sides are broadcast only when their row count is within
``BROADCAST_QUERIES``; beyond it the join is left to the planner.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.config import DEFAULTS
from siltstone.functions import text as T

BROADCAST_QUERIES = 10_000
TERM = "[a-z0-9]+"


def small(df: DataFrame, most: int = BROADCAST_QUERIES) -> DataFrame:
    """Broadcast hint only behind a check of the size."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def terms(text: Column) -> Column:
    return T.all_found(F.lower(text), TERM)


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term, tf, dl). Counts are made in each row's task by one aggregate; the document's length rides along."""
    words = docs.select(F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("t"))
    return words.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select("doc_id", "term", "tf", "dl")


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query: str, k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b) -> DataFrame:
    """(query_id, doc_id, score): documents that share a term with a query; idf and mean length over all documents."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(terms(F.col(query)))).alias("term"))
    # one size check bounds all three small sides: none has more rows than the queries have terms
    hint = F.broadcast if asked.limit(200_001).count() <= 200_000 else (lambda df: df)
    wanted = hint(asked.select("term").distinct())
    counts = docs.select(F.count(F.lit(1)).alias("n"), F.avg(F.size(terms(F.col(text)))).alias("mean"))
    # only asked terms are counted: the semi-join comes before the aggregate's shuffle
    words = docs.select(F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("t"))
    kept = words.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(wanted, "term", "left_semi")
    tf = kept.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hint(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    weighed = tf.join(df, "term").crossJoin(F.broadcast(counts))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    return weighed.select("doc_id", "term", part.alias("part")).join(hint(asked), "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def dense(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score): inner products of the stated queries (query_id, query_vector) with all other rows."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    pairs = in_blocks(rows, queries.select("query_id", "query_vector")).where("vec_id <> query_id")
    return pairs.select("query_id", "vec_id", F.round(T.dot(F.col("v"), F.col("query_vector")), 6).alias("score"))


def dense_all(vectors: DataFrame, queries: DataFrame, item: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(query_id, item, score): inner products of the stated queries with all rows."""
    rows = vectors.select(F.col(item).alias(item), F.col(vector).alias("v"))
    return in_blocks(rows, queries.select("query_id", "query_vector")).select("query_id", item, F.round(T.dot(F.col("v"), F.col("query_vector")), 6).alias("score"))


def dense_top(rows: DataFrame, queries: DataFrame, k: int = DEFAULTS.top_k, but_self: bool = False, most: int = 4_000, scale: Column | None = None) -> DataFrame:
    """(query_id, item, score, rank) of rows (item, embedding) and stated queries (query_id, query_vector): the k largest inner
    products, to six places, ties to the smaller item. With ``scale``, an expression of item, products to six places are multiplied
    by it, to six places again.

    Queries go to all tasks in blocks of ``most``. A task multiplies its rows with a block in batches and keeps a bounded list for
    each query, so that only the best of a task leave it; ranks are made once, over tasks x k rows a query.
    """
    spark, n = rows.sparkSession, queries.count()
    kind = queries.select("query_id").schema[0].dataType
    given = rows.select("item", F.col("embedding").cast("array<double>").alias("embedding"), *([] if scale is None else [scale.cast("double").alias("scale")])).where("embedding is not null")
    # so much can two scores that are told apart to six places differ before they are rounded
    slack = 1.1e-6 * (1 if scale is None else 1 + (given.agg(F.max(F.abs("scale"))).first()[0] or 0))
    found = []
    for block in range(max(1, -(-n // most))):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // most)))) == block) if n > most else queries
        asked = own.select("query_id", F.col("query_vector").cast("array<double>").alias("v")).where("v is not null").orderBy("query_id").toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((asked.column(0), vectors_of(asked.column(1))))  # a block's vectors
        found.append(given.mapInArrow(best_of_task(shared, k, but_self, slack), f"query_id {kind.simpleString()}, item {dict(given.dtypes)['item']}, score double"))
    score = F.round("score", 6)
    every = reduce(DataFrame.unionByName, found).withColumn("score", score if scale is None else F.round(score * scale, 6))
    return top_k(every, "item", k)


def dense_ranked(rows: DataFrame, queries: DataFrame, k: int, scale: Column | None = None) -> DataFrame:
    """``dense_top`` of each query and all other rows. Vectors without numbers (null, or with an element that is null, NaN or
    infinite) meet the others one by one, as an expression: their scores have a rank as well, null the last."""

    def odd(v: Column) -> Column:
        return v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    row, asked = odd(F.col("embedding")), odd(F.col("query_vector"))
    if not rows.where(row).limit(1).count() and not queries.where(asked).limit(1).count():
        return dense_top(rows, queries, k, True, scale=scale)
    best = dense_top(rows.where(~row), queries.where(~asked), k, True, scale=scale).drop("rank")
    pairs = in_blocks(rows.where(row), queries).unionByName(in_blocks(rows.where(~row), queries.where(asked))).where("item <> query_id")
    score = F.round(T.dot(F.col("embedding"), F.col("query_vector")), 6)
    return top_k(best.unionByName(pairs.select("query_id", "item", (score if scale is None else F.round(score * scale, 6)).alias("score"))), "item", k)


def vectors_of(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def firsts_of_equals(s: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Where the k smallest items of each score are, by falling scores."""
    order = np.argsort(v, kind="stable")
    order = order[np.argsort(-s[order], kind="stable")]
    first = np.flatnonzero(np.r_[True, np.diff(s[order]) != 0])
    return order[np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)])) < k]


def smallest_of_equals(s: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest items of each score."""
    order = firsts_of_equals(s, v, k)
    return s[order], v[order]


def six_places(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6


def best_of_task(shared, k: int, but_self: bool, slack: float = 1.1e-6):
    def run(batches):
        ids, q = shared.value
        own = ids.to_numpy(zero_copy_only=False)
        best: list = [None] * len(own)
        least = np.full(len(own), -np.inf)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            if not batch.num_rows or not len(own):
                continue
            items, rows = batch.column(0).to_numpy(zero_copy_only=False), vectors_of(batch.column(1))
            scale = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else None
            for a in range(0, len(own), 256):
                products = q[a : a + 256] @ rows.T
                scores = products if scale is None else products * scale
                for i in np.flatnonzero(scores.max(1) >= least[a : a + 256]).tolist():
                    keep = scores[i] >= least[a + i]
                    if but_self:
                        keep &= items != own[a + i]
                    p, v = products[i][keep], items[keep]
                    s = p if scale is None else six_places(six_places(p) * scale[keep])
                    if best[a + i] is not None:
                        s, v, p = (np.concatenate(x) for x in zip(best[a + i], (s, v, p), strict=True))
                    if len(s) > k:  # what ties with the k-th to six places stays for the ranks; of equal scores the smaller items
                        least[a + i] = np.partition(s, -k)[-k] - slack
                        s, v, p = (x[s >= least[a + i]] for x in (s, v, p))
                        order = firsts_of_equals(s, v, k)
                        s, v, p = s[order], v[order], p[order]
                    best[a + i] = (s, v, p)
        at = [i for i, x in enumerate(best) if x is not None and len(x[0])]
        if at:
            _, v, p = (np.concatenate(x) for x in zip(*[best[i] for i in at], strict=True))
            whose = ids.take(pa.array(np.repeat(at, [len(best[i][0]) for i in at])))
            whose = whose.combine_chunks() if isinstance(whose, pa.ChunkedArray) else whose
            yield pa.record_batch([whose, pa.array(v, kind), pa.array(p, pa.float64())], ["query_id", "item", "score"])

    return run


def in_blocks(rows: DataFrame, queries: DataFrame, most: int = 2_000) -> DataFrame:
    """Every row with every stated query. Queries go to all tasks in blocks of about ``most``, so that no task holds more than
    one block; each block is a join of its own over the rows."""
    blocks = max(1, -(-queries.count() // most))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(queries.where(block == i)), F.lit(True)) for i in range(blocks)])


def top_k(hits: DataFrame, item: str, k: int = DEFAULTS.top_k, score: str = "score", query: str = "query_id") -> DataFrame:
    """The k best of each query with rank from 1; ties to the smaller item."""
    order = Window.partitionBy(query).orderBy(F.desc(score), item)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(lists: list[DataFrame], item: str, k: int = DEFAULTS.rrf_k) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, item, rank from 1)."""
    every = None
    for ranked in lists:
        part = ranked.select("query_id", item, (1.0 / (k + F.col("rank") - 1)).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("query_id", item).agg(F.round(F.sum("part"), 9).alias("score"))


def over_fetch(k: int) -> int:
    return max(2 * k, 20)


def hybrid(dense_hits: DataFrame, lexical_hits: DataFrame, item: str, k: int = DEFAULTS.top_k, rrf_k: int = DEFAULTS.rrf_k) -> DataFrame:
    """Both branches over-fetch, then their ranks are fused; a query without lexical hits keeps its dense scores."""
    branch = over_fetch(k)
    return fused(top_k(dense_hits, item, branch), top_k(lexical_hits, item, branch), item, k, rrf_k)


def fused(a: DataFrame, b: DataFrame, item: str, k: int = DEFAULTS.top_k, rrf_k: int = DEFAULTS.rrf_k) -> DataFrame:
    """``hybrid`` from ranked lists, dense and lexical."""
    both = b.select("query_id").distinct()
    mixed = top_k(rrf([a.join(both, "query_id", "left_semi"), b], item, rrf_k), item, k)
    alone = top_k(a.join(both, "query_id", "left_anti").select("query_id", item, "score"), item, k)
    return mixed.select("query_id", item, "score", "rank").unionByName(alone.select("query_id", item, "score", "rank"))


def merged(hits: DataFrame, item: str, score: str = "score", seq: str = "seq", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row an item with its best score; of equal scores the first seen stays. Pre-aggregates before the shuffle."""
    rest = [c for c in hits.columns if c not in (*keys, item)]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(seq))).alias("best")
    return hits.groupBy(*keys, item).agg(best).select(*keys, item, "best.*")


def rescale(value: Column, window) -> Column:
    lo, hi = F.min(value).over(window), F.max(value).over(window)
    return F.when(hi > lo, 0.05 + 0.95 * (value - lo) / (hi - lo)).otherwise(F.lit(1.0))


def blended(pool: DataFrame, logit: str = "logit", prior: str = "score", query: str = "query_id", seq: str = "seq", weight: float = DEFAULTS.rerank_weight, candidates: int = DEFAULTS.rerank_candidates, keep: int = 0) -> DataFrame:
    """The first ``candidates`` of each pool in order of w * rescaled sigmoid + (1 - w) * rescaled prior; the tail follows
    with its old scores; ``keep`` rows stay, 80 where it is 0. Pools with fewer than two rows stay as they are."""
    order = Window.partitionBy(query).orderBy(seq)
    placed = pool.withColumn("at", F.row_number().over(order)).withColumn("pool", F.count(F.lit(1)).over(Window.partitionBy(query)))
    placed = placed.withColumn("tail", F.col("at") > candidates)
    group = Window.partitionBy(query, "tail")
    mixed = weight * rescale(T.sigmoid(F.col(logit)), group) + (1 - weight) * rescale(F.col(prior), group)
    scored = placed.withColumn("blend", F.when(F.col("tail") | (F.col("pool") < 2), F.col(prior)).otherwise(F.round(mixed, 6)))
    final = Window.partitionBy(query).orderBy("tail", F.when(F.col("tail"), F.lit(0.0)).otherwise(-F.col("blend")), seq)
    return scored.withColumn("rank", F.row_number().over(final)).where((F.col("rank") <= (keep or DEFAULTS.pool_cap)) | (F.col("pool") < 2)).drop("at", "pool")


def lexical_logit(query: Column, passage: Column, chars: int = DEFAULTS.rerank_chars) -> Column:
    """The default scorer: how many of the question's words a passage's head has, as a logit."""
    asked = F.array_distinct(terms(query))
    share = F.size(F.array_intersect(asked, terms(F.substring(passage, 1, chars)))) / F.greatest(F.size(asked), F.lit(1))
    return 8.0 * share - 4.0


def multihop_depth(questions: int) -> int:
    return max(4, DEFAULTS.top_k // max(1, questions) + 2)


def excluding(hits: DataFrame, seen: DataFrame, item: str) -> DataFrame:
    return hits.join(seen.select(item).distinct(), item, "left_anti")


def by_ids(chunks: DataFrame, ids: DataFrame, item: str = "chunk_id", cap: int = DEFAULTS.lookup_cap) -> DataFrame:
    """Lookups in first-seen order (``ids`` has ord), each id once, with the graph's score."""
    first = ids.groupBy(item).agg(F.min("ord").alias("ord")).orderBy("ord").limit(cap)
    return chunks.join(F.broadcast(first), item).withColumn("score", F.lit(DEFAULTS.graph_score))  # at most cap rows
