"""Exact top-k inner-product search by KD-trees (operator 7).

The vectors are dealt to shards of at most about ``shard_rows`` rows by a hash. Each shard is a KD-tree: median splits of
the dimension with the widest spread, tight bounding boxes, leaves of ``leaf_rows``, boxes of boxes up to the root. A box
bounds a query's inner product by sum(max(q * low, q * high)). Queries come in blocks of ``block_rows``; a search descends from
the root past boxes that no query of the block needs, goes through the leaves best bound first, and stops at the k-th score
known so far. That k-th score is propagated: the first round searches one shard for each block and
its k-th scores are the starting bounds of all other shards in the second round.

Components are integers (quantized before) and so are the scores: products are made in doubles where every partial sum is
below 2**53, else in 64-bit integers, and bounds are widened by what doubles may lose. Ties go to the smaller id.

Defined cases: vectors that are null or hold a null or non-finite component take no part, neither as query nor as
candidate; a vector with fewer components than another counts as filled up with zeros; scores beyond 64 bits are not defined;
fewer candidates than k give fewer ranks; identical vectors are separate candidates; rows that repeat a vec_id
are separate candidates, and a query never meets rows of its own id; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_batches, written


#: Boxes that have one parent box.
FAN = 8


@dataclass(frozen=True)
class Params:
    k: int = 20
    shard_rows: int = 16_384
    leaf_rows: int = 128
    block_rows: int = 512
    group_leaves: int = 16
    task_blocks: int = 16


class Tree:
    """Leaves of a median-split KD-tree with tight boxes, as arrays; rows are in leaf order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int):
        order, self.cuts = np.arange(len(ids)), [0]
        stack = [(0, len(ids))]
        while stack:
            a, b = stack.pop()
            if b - a <= leaf_rows:
                self.cuts.append(b)
                continue
            part = rows[order[a:b]]
            dim = int((part.max(0) - part.min(0)).argmax())
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, dim], mid)]
            stack += [(a + mid, b), (a, a + mid)]  # the left half is taken first, so cuts ascend
        self.ids, self.whole = ids[order], rows[order]
        self.rows = self.whole.astype(np.float64)
        self.most = float(np.abs(self.rows).max()) if self.rows.size else 0.0
        firsts = np.array(self.cuts[:-1], dtype=np.int64)
        self.low = np.minimum.reduceat(self.rows, firsts) if len(ids) else self.rows
        self.high = np.maximum.reduceat(self.rows, firsts) if len(ids) else self.rows
        # boxes of boxes, up to the root: neighbouring leaves have one parent split in common
        self.inner, low, high = [], self.low, self.high
        while len(low) > 1:
            ends = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, ends), np.maximum.reduceat(high, ends)
            self.inner.append((low, high))

    def bounds(self, queries: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores: one row a query, one column a leaf. max(q*l, q*h) = q+ * h - q- * l.

        From the root down: below a box that no query's k-th score lets in, leaves are left out (bound -inf).
        """
        q = queries.astype(np.float64)
        plus, minus, lost, floor = np.maximum(q, 0), np.maximum(-q, 0), self.lost(q), limit.astype(np.float64)[:, None]
        alive = np.zeros(1, np.int64)
        for level in range(len(self.inner) - 1, -1, -1):
            low, high = self.inner[level]
            bound = plus @ high[alive].T - minus @ low[alive].T + lost
            below = len(self.inner[level - 1][0] if level else self.low)
            alive = (alive[(bound >= floor).any(0)][:, None] * FAN + np.arange(FAN)).ravel()
            alive = alive[alive < below]
        out = np.full((len(q), len(self.low)), -np.inf)
        out[:, alive] = plus @ self.high[alive].T - minus @ self.low[alive].T + lost
        return out

    def reach(self, queries: np.ndarray) -> float:
        """The largest sum of a score's parts in absolute value."""
        return self.most * float(np.abs(queries.astype(np.float64)).max(initial=0)) * self.rows.shape[1]

    def lost(self, queries: np.ndarray) -> float:
        """What rounding may take from a bound."""
        reach = self.reach(queries)
        return 0.0 if reach < 2**53 else reach * (self.rows.shape[1] + 4) * 2.0**-52

    def scores(self, queries: np.ndarray, a: int, b: int, exact: bool) -> np.ndarray:
        """Integer scores of queries and rows a to b."""
        if exact:
            return (queries.astype(np.float64) @ self.rows[a:b].T).astype(np.int64)
        return queries @ self.whole[a:b].T


def search(tree: Tree, q_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, score) of each query's k best in the tree that reach ``kth``.

    Each query takes its leaves by descending bound; each round the queries that still have a leaf that may reach their k-th
    score look at their next ``step`` leaves, and leaves shared by several queries are scored by one product.
    """
    n = len(q_ids)
    bound = tree.bounds(queries, kth)
    turn = np.argsort(-bound, axis=1, kind="stable")
    exact = tree.reach(queries) < 2**53
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
    limit = kth.astype(np.int64).copy()
    live, at = np.arange(n), 0
    while len(live) and at < turn.shape[1]:
        todo: dict[int, list[int]] = {}
        for col in range(at, min(at + step, turn.shape[1])):
            leaf = turn[live, col]
            for i in np.flatnonzero(bound[live, leaf] >= limit[live].astype(np.float64)).tolist():
                todo.setdefault(int(leaf[i]), []).append(int(live[i]))
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for leaf, asked in todo.items():
            a, b = tree.cuts[leaf], tree.cuts[leaf + 1]
            scores, ids = tree.scores(queries[asked], a, b, exact), tree.ids[a:b]
            for i, s in zip(asked, scores, strict=True):
                keep = (s >= limit[i]) & (ids != q_ids[i])
                if keep.any():
                    found.setdefault(i, []).append((s[keep], ids[keep]))
        for i, parts in found.items():
            s, v = (np.concatenate([best[i][j], *(p[j] for p in parts)]) for j in (0, 1))
            if len(s) > k:
                top = np.lexsort((v, -s))[:k]
                s, v = s[top], v[top]
            best[i] = (s, v)
            if len(s) == k:
                limit[i] = max(limit[i], s.min())
        at += step
        if at < turn.shape[1]:
            live = live[bound[live, turn[live, at]] >= limit[live].astype(np.float64)]
    sizes = [len(s) for s, _ in best]
    return (
        np.repeat(np.arange(n), sizes),
        np.concatenate([v for _, v in best]) if n else np.zeros(0, np.int64),
        np.concatenate([s for s, _ in best]) if n else np.zeros(0, np.int64),
    )


def quantized(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * component); rows with null or non-finite components are left out."""
    finite = F.forall(F.col("v0"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v0"))
    return src.where(F.col("vec_id").isNotNull() & F.col("v0").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        "vec_id", F.transform("v0", lambda x: F.floor(x * scale).cast("long")).alias("v")
    )


def top_k(vectors: DataFrame, is_query, params: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``vectors`` (vec_id long, v array<long>); ``is_query`` is a condition on them."""
    spark = bounded_batches(vectors.sparkSession)
    base = written(vectors.withColumn("q", is_query), "vectors")
    n, n_q, dims, least = base.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("int")), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.min(F.size("v"))).first()
    if least is not None and least < dims:
        base = base.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v"))))
    shards, blocks = max(1, -(-n // params.shard_rows)), max(1, -(-n_q // params.block_rows))
    k, leaf_rows, step = params.k, params.leaf_rows, params.group_leaves
    salt = F.xxhash64("vec_id", "v")  # equal ids or equal vectors alone don't meet in one shard
    placed = base.select("vec_id", "v", F.pmod(salt, F.lit(shards)).cast("int").alias("shard"))
    asked = base.where("q").select(F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"), F.pmod(F.xxhash64(F.lit(7), salt), F.lit(blocks)).cast("int").alias("block"))

    def arrays(batch: pa.Table, at: int) -> tuple[np.ndarray, np.ndarray]:
        flat = batch.column(at + 1).combine_chunks()
        ids = batch.column(at).to_numpy().astype(np.int64)
        return ids, flat.flatten().to_numpy().astype(np.int64).reshape(len(ids), dims)

    def run(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "block": pa.array([], pa.int32())})
        ids, data = arrays(rows, 0)
        tree = Tree(ids, data, leaf_rows)
        out = []
        every, block = queries.column("block").to_numpy(), None
        for block in np.unique(every):
            part = queries.filter(pa.array(every == block))
            q_ids, q = arrays(part, 0)
            kth = part.column("kth").fill_null(-(1 << 63)).to_numpy()
            who, v, s = search(tree, q_ids, q, kth, k, step)
            out.append(pa.table({"query_id": q_ids[who], "vec_id": v, "score": s, "block": np.full(len(who), block, np.int32)}))
        return pa.concat_tables(out)

    kind = "query_id long, vec_id long, score long, block int"

    def searched(queries: DataFrame, pair) -> DataFrame:
        """Searches the shards for which ``pair(shard, part)`` holds; a task has one shard and ``task_blocks`` query blocks."""
        part = F.col("block").cast("int") / params.task_blocks
        left = placed.withColumn("part", F.explode(F.filter(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: pair(F.col("shard"), p))))
        ask = queries.withColumn("at_part", F.floor(part).cast("int")).withColumn(
            "at", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: pair(s, F.floor(part).cast("int"))))
        )
        ask = ask.select("q_id", "q_v", "kth", "block", "at", "at_part")
        return left.groupBy("shard", "part").cogroup(ask.groupBy("at", "at_part")).applyInArrow(run, kind)

    parts = -(-blocks // params.task_blocks)
    home = written(searched(asked.withColumn("kth", F.lit(None).cast("long")), lambda s, p: s == F.pmod(p, F.lit(shards))), "home")
    if shards > 1:
        known = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        rest = asked.join(known, F.col("q_id") == F.col("query_id"), "left").select("q_id", "q_v", "kth", "block")
        found = home.unionByName(searched(rest, lambda s, p: s != F.pmod(p, F.lit(shards))))
    else:
        found = home
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
