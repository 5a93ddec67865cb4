"""Approximate nearest neighbours by a forest of random-projection trees (operator 11).

1. Fit. A sample of at most ``sample_bytes`` of vectors gives the trees: each node splits at the median of its rows' projections
   on a random direction, down to leaves of about ``leaf_rows`` rows of the whole table. Every row of the table goes down every
   tree; only the directions and medians come from the sample.
2. Search. A query goes down all trees at once through one priority queue: the node taken next, of whatever tree, is the one
   with the least sum of squared distances to the splits on whose other side it lies. It ends after ``leaves`` leaves, a
   number that the fit finds: the least at which sampled queries, against the sample, reach ``recall`` of their exact neighbours
   (on the whole table neighbours are nearer, so that it does no worse there; tests measure it).
3. Rerank. Neighbouring leaves of a tree make a unit of about ``unit_rows`` rows (larger ones are dealt over salts). A unit's
   task multiplies each leaf with the queries that came to it; only a query's best rows leave the task, with cosines in double
   precision from the vectors as given.

Equal vectors are one row with the least ids that a result may need, as candidates and as queries, so a vector that fills a third
of the table costs as much as any other.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take no part, neither as query nor as
candidate, nor do rows without an id; shorter vectors count as filled up with zeros; fewer candidates than k give fewer ranks;
ties go to the smaller id; rows that repeat an id are candidates each, named once for a query, and a query never meets rows of
its own id; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_batches, few, written


@dataclass(frozen=True)
class Params:
    k: int = 5
    trees: int = 8
    leaf_rows: int = 256
    most_depth: int = 12
    recall: float = 0.985
    sample_bytes: int = 16 << 20
    sample_queries: int = 256
    unit_rows: int = 16_384
    block_queries: int = 16_384
    seed: int = 11


class Forest:
    """Trees as arrays: node i of a level has the children 2i and 2i + 1 on the next one."""

    def __init__(self, sample: np.ndarray, depth: int, p: Params):
        rng = np.random.default_rng(p.seed)
        self.depth, self.trees, self.leaves = depth, p.trees, p.trees << depth
        self.directions, self.cuts = [], []
        for _ in range(p.trees):
            node, directions, cuts = np.zeros(len(sample), np.int64), [], []
            for level in range(depth):
                d = rng.standard_normal((1 << level, sample.shape[1])).astype(np.float32)
                d /= np.linalg.norm(d, axis=1, keepdims=True)
                x = along(sample, d, node)
                order = np.lexsort((x, node))
                ends = np.searchsorted(node[order], np.arange((1 << level) + 1))
                ranked, cut = x[order], np.zeros(1 << level, np.float32)
                for i in np.flatnonzero(np.diff(ends)):
                    cut[i] = ranked[(ends[i] + ends[i + 1] - 1) // 2]
                node = 2 * node + (x > cut[node])
                directions.append(d)
                cuts.append(cut)
            self.directions.append(directions)
            self.cuts.append(cuts)

    def leaf_of(self, rows: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        for d, cut in zip(self.directions[tree], self.cuts[tree], strict=True):
            node = 2 * node + (along(rows, d, node) > cut[node])
        return node

    def search(self, queries: np.ndarray, leaves: int):
        """For each query the (tree, leaf) pairs that the shared queue gives first, as numbers tree << depth | leaf."""
        for at in range(0, len(queries), 64):
            part = queries[at : at + 64]
            beyond = [[(part @ d.T - cut).tolist() for d, cut in zip(*x, strict=True)] for x in zip(self.directions, self.cuts, strict=True)]
            for i in range(len(part)):
                queue, out = [(0.0, t, 0, 0) for t in range(self.trees)], []
                while queue and len(out) < leaves:
                    far, t, level, node = heapq.heappop(queue)
                    while level < self.depth:  # down the near side; the far one waits in the queue
                        x = beyond[t][level][i][node]
                        right = x > 0
                        heapq.heappush(queue, (far + x * x, t, level + 1, 2 * node + (not right)))
                        level, node = level + 1, 2 * node + right
                    out.append(t << self.depth | node)
                yield out


def along(rows: np.ndarray, directions: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Each row's projection on its node's direction."""
    return np.concatenate([np.einsum("ij,ij->i", rows[a : a + 8192], directions[node[a : a + 8192]]) for a in range(0, len(rows), 8192)] or [np.zeros(0, np.float32)])


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, in single precision; scaled first, so that no square is lost."""
    if not len(rows):
        return rows.astype(np.float32)
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def fit(sample: np.ndarray, rows: int, p: Params) -> tuple[Forest, int]:
    """The forest for a table of ``rows`` rows, and how many leaves a query needs."""
    most = len(sample).bit_length() - 4  # some sampled rows in each leaf
    depth = max(0, min(p.most_depth, most, round(np.log2(max(1, rows / p.leaf_rows)))))
    forest = Forest(sample, depth, p)
    if len(sample) < 2 or not depth:
        return forest, forest.leaves
    asked = np.random.default_rng(p.seed + 1).permutation(len(sample))[: p.sample_queries]
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -np.inf
    k = min(p.k, len(sample) - 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    at = np.stack([(t << depth) | forest.leaf_of(sample, t)[best] for t in range(p.trees)])
    turn = np.full(best.shape, forest.leaves, np.int64)
    for i, found in enumerate(forest.search(sample[asked], forest.leaves)):
        place = np.empty(forest.leaves, np.int64)
        place[found] = np.arange(1, forest.leaves + 1)
        turn[i] = place[at[:, i]].min(0)
    return forest, int(np.sort(turn.ravel())[int(np.ceil(p.recall * turn.size)) - 1])


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    src = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return src.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def merged(rows: DataFrame, k: int) -> DataFrame:
    """(rep, v, ids, asked): each distinct vector with its k + 1 least ids, and whether a query has it; ids are ranked in salted
    parts first, so that no task sorts all rows of one vector."""
    every = rows
    for by in (["v", F.pmod(F.xxhash64("vec_id"), F.lit(64))], ["v"]):
        order = Window.partitionBy(*by).orderBy("vec_id")
        every = every.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1).drop("at")
    ids = every.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    return ids.select(F.col("ids")[0].alias("rep"), "v", "ids")


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each summed in the same order whatever stands beside it."""
    query, rows = query.astype(np.float64), rows.astype(np.float64)
    query, rows = query / np.abs(query).max(), rows / np.abs(rows).max(1, keepdims=True)
    return (rows * query).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))


def nearest(query: np.ndarray, rows: np.ndarray, reps: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, cosines) of the k best rows: chosen by rough scores, all within rounding of the k-th scored exactly."""
    least = np.partition(rough, -k)[-k] - 1e-4 if len(rough) > k else -np.inf
    keep = np.flatnonzero((rough >= least) & (rough > -np.inf))
    if not len(keep):
        return keep, np.zeros(0)
    score = cosines(query, rows[keep])
    top = np.lexsort((reps[keep], -score))[:k]
    return keep[top], score[top]


def search(vectors: DataFrame, is_query: Column, params: Params = Params(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of the rows for which ``is_query``, a condition on vec_id, holds."""
    p, spark = params, bounded_batches(vectors.sparkSession)
    rows = usable(vectors, vec_id, vector)
    n, dims, least = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1)), F.coalesce(F.min(F.size("v")), F.lit(1))).first()
    if least < dims:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.element_at("v", 1) * 0, F.lit(dims) - F.size("v"))))
    base = written(merged(rows, p.k), "vectors")
    asked = written(rows.where(is_query).select("vec_id", "v").join(base.select("rep", "v"), "v").select("vec_id", "rep"), "queries")
    most = max(64, p.sample_bytes // (4 * dims))
    share = F.lit(min(1 << 20, (9 * most << 20) // (10 * max(1, n))))
    part = base.where(F.xxhash64("rep", F.lit(p.seed)).bitwiseAND(F.lit((1 << 20) - 1)) < share).limit(most)
    sample = part.select("rep", "v").orderBy("rep").toArrow()
    forest, leaves = fit(unit(matrix(sample.column("v"), dims)), n, p)
    shared = spark.sparkContext.broadcast(forest)
    shift = forest.depth - max(0, min(forest.depth, round(np.log2(max(1.0, n / p.unit_rows)))))
    there = written(placed(base, shared, shift, dims), "leaves")
    wanted = written(chosen(base.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v"), shared, leaves, shift, dims), "wanted")
    # a large unit is dealt over salts, and many queries of one over blocks; there are at most trees << most_depth units
    parts = lambda frame, rows, name: frame.groupBy("unit").agg(F.ceil(F.count("*") / rows).alias(name))
    dealing = written(parts(there, p.unit_rows, "salts").join(parts(wanted, p.block_queries, "blocks"), "unit"), "dealing")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = there.join(few(dealing), "unit").withColumn("salt", F.pmod(F.xxhash64("rep"), "salts")).withColumn("block", each("blocks"))
    wanted = wanted.join(few(dealing), "unit").withColumn("block", F.pmod(F.xxhash64("query"), "blocks")).withColumn("salt", each("salts"))
    k = p.k + 1

    def run(asked_: pa.Table, rows_: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked_.num_rows and rows_.num_rows:
            leaf, reps, given = rows_.column("leaf").to_numpy(), rows_.column("rep").to_numpy(), matrix(rows_.column("v"), dims)
            order = np.argsort(leaf, kind="stable")
            leaf, reps, given = leaf[order], reps[order], given[order]
            first = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
            spans = dict(zip(leaf[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(leaf)], strict=True), strict=True))
            short, names = unit(given), asked_.column("query").to_pylist()
            whole, leaves_ = matrix(asked_.column("w"), dims), asked_.column("leaves").to_pylist()
            for a in range(0, len(names), 128):
                some, by = unit(whole[a : a + 128]), {}
                for i, found in enumerate(leaves_[a : a + 128]):
                    for x in found:
                        by.setdefault(x, []).append(i)
                rough = np.full((len(some), len(leaf)), -np.inf, np.float32)
                for x, who in by.items():
                    if x in spans:
                        lo, hi = spans[x]
                        rough[who, lo:hi] = some[who] @ short[lo:hi].T
                for i, scores in enumerate(rough):
                    place, score = nearest(whole[a + i], given, reps, scores, k)
                    out += zip([names[a + i]] * len(place), reps[place].tolist(), score.tolist(), strict=True)
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query": pa.array(cols[0], pa.int64()), "rep": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    by_unit = ("unit", "salt", "block")
    asking = wanted.select(*by_unit, "query", "w", "leaves").groupBy(*by_unit)
    found = asking.cogroup(dealt.select(*by_unit, "leaf", "rep", "v").groupBy(*by_unit)).applyInArrow(run, "query long, rep long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    # trees find the same rows again; a query has a few from each unit
    top = written(found.distinct().withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).drop("at"), "found")
    named = top.join(base.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    listed = named.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("found"))  # (k + 1) squared at most
    mine = asked.withColumnRenamed("vec_id", "query_id").distinct().join(listed, F.col("rep") == F.col("query"))
    others = F.slice(F.filter(F.array_distinct("found"), lambda x: x["vec_id"] != F.col("query_id")), 1, p.k)
    return mine.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.less")).alias("score"))


def placed(base: DataFrame, shared, shift: int, dims: int) -> DataFrame:
    """(unit, leaf, rep, v): each row in its leaf of each tree; a unit is a run of 2 ** shift leaves of a tree."""

    def run(batches):
        forest = shared.value
        for batch in batches:
            rows = unit(matrix(batch.column("v"), dims))
            for t in range(forest.trees if batch.num_rows else 0):
                leaf = forest.leaf_of(rows, t) | t << forest.depth
                yield pa.record_batch([pa.array(leaf >> shift), pa.array(leaf), batch.column("rep"), batch.column("v")], ["unit", "leaf", "rep", "v"])

    return base.select("rep", "v").mapInArrow(run, f"unit long, leaf long, rep long, v {dict(base.dtypes)['v']}")


def chosen(queries: DataFrame, shared, leaves: int, shift: int, dims: int) -> DataFrame:
    """(query, w, unit, leaves): a query's leaves by unit, so that it travels once to each unit."""

    def run(batches):
        forest = shared.value
        for batch in batches:
            rows = matrix(batch.column("v"), dims)
            for at in range(0, len(rows), 64):
                who, units, inside = [], [], []
                for i, found in enumerate(forest.search(unit(rows[at : at + 64]), leaves)):
                    by: dict[int, list[int]] = {}
                    for x in found:
                        by.setdefault(x >> shift, []).append(x)
                    who += [at + i] * len(by)
                    units += by
                    inside += by.values()
                take = pa.array(who, pa.int64())
                yield pa.record_batch([batch.column("rep").take(take), batch.column("v").take(take), pa.array(units, pa.int64()), pa.array(inside, pa.list_(pa.int64()))], ["query", "w", "unit", "leaves"])

    return queries.mapInArrow(run, f"query long, w {dict(queries.dtypes)['v']}, unit long, leaves array<long>")
