"""Retrieval by route over tables of questions: seeds, k-hop traversals that end in chunks, and the routes' unions.

Questions are (query_id, question), entities (id, norm_name, name, description, mentions), edges (source, predicate, target,
weight, chunks array<long>) between entity ids, mentions (id, chunk_id). All results are (query_id, chunk_id, score, seq).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.config import DEFAULTS as D
from siltstone.functions import text as T
from siltstone.operators import graph
from siltstone.operators import retrieval as R
from siltstone.plans.lineage import cut


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) > 2))


def found_seeds(questions: DataFrame, entities: DataFrame, cap: int = D.seeds, pool: int = D.seed_pool) -> DataFrame:
    """(question_id, question, seq, id, norm_name, mentions): entities whose name or description has a term of the question, or
    one an edit away in its name; by summed idf of the terms. Questions without any take entities whose name contains one of
    their first eight terms, by mentions. ``pool`` times ``cap`` are fetched, as filters follow."""
    # a term and its rows meet under equal words or equal words with one letter left out
    short = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))))
    asked = questions.select(F.col("query_id").alias("question_id"), "question", F.explode(F.array_distinct(F.transform(T.question_terms(F.col("question")), F.lower))).alias("term"))
    owned = entities.select("id", F.explode(words(F.concat_ws(" ", "name", "description"))).alias("word"), F.lit(False).alias("fuzzy"))
    named = entities.select("id", F.explode(words(F.col("name"))).alias("word"), F.lit(True).alias("fuzzy"))
    index = owned.unionByName(named.where(F.length("word") > 3)).distinct()
    near = asked.select("question_id", "term", F.explode(short(F.col("term"))).alias("k")).join(index.where("fuzzy").select("id", "word", F.explode(short(F.col("word"))).alias("k")), "k")
    near = near.where(F.levenshtein("term", "word", 1) >= 0).select("question_id", "term", "id", F.lit(0.5).alias("worth"))
    same = asked.join(index.where("not fuzzy"), F.col("term") == F.col("word")).select("question_id", "term", "id", F.lit(1.0).alias("worth"))
    # what is read more than once is computed once: else each use repeats the plan above it
    hits = cut(same.unionByName(near).groupBy("question_id", "term", "id").agg(F.max("worth").alias("worth")))
    df = hits.select("term", "id").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = entities.agg(F.count(F.lit(1)).alias("n"))
    scored = hits.join(df, "term").crossJoin(F.broadcast(total))  # one row
    scored = cut(scored.groupBy("question_id", "id").agg(F.round(F.sum(F.col("worth") * F.log(1 + F.col("n") / F.col("df"))), 6).alias("score")))
    rest = questions.join(scored.select(F.col("question_id").alias("query_id")).distinct(), "query_id", "left_anti")
    first = rest.select(F.col("query_id").alias("question_id"), F.explode(F.slice(F.transform(T.question_terms(F.col("question")), F.lower), 1, 8)).alias("term"))
    part = entities.join(R.small(first.select("term").distinct()), F.contains("norm_name", F.col("term"))).select("term", "id", "mentions")
    contained = first.join(part, "term").groupBy("question_id", "id").agg(F.max("mentions").cast("double").alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    best = scored.unionByName(contained).withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= cap * pool)
    return best.join(questions.select(F.col("query_id").alias("question_id"), "question"), "question_id").join(entities.select("id", "norm_name", "mentions"), "id").select("question_id", "question", "seq", "id", "norm_name", "mentions")


def starts(questions: DataFrame, entities: DataFrame, cap: int = D.seeds) -> DataFrame:
    """(query_id, node): the seeds of each question after the filters, ``cap`` at most."""
    pool = cut(found_seeds(questions, entities, cap))
    kept = graph.seeds(pool, "question").withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("strong"), "seq"))).where(F.col("rank") <= cap)
    return kept.join(pool.select("question_id", "seq", "id"), ["question_id", "seq"]).select(F.col("question_id").alias("query_id"), F.col("id").alias("node"))


def hops(edges: DataFrame, entities: DataFrame, start: DataFrame, depth: int = D.hops, cap: int = D.edge_cap) -> DataFrame:
    """(query_id, source, predicate, target, weight, chunks, rank): for each question the edges within reach of its seeds,
    heaviest first. Only nodes that are no hubs pass on; edges between two hubs go. Frontiers are kept by question."""
    entities = entities.withColumnRenamed("id", "node") if "id" in entities.columns else entities
    marked = cut(entities.crossJoin(F.broadcast(graph.hub_cutoff(entities))).select("node", (F.col("mentions") >= F.col("cutoff")).alias("hub")))  # one row
    plain, hubs = marked.where("not hub").select("node"), marked.where("hub").select("node")
    ways = graph.both_ways(edges).select("node", "other").distinct()
    seen = cut(start.select("query_id", "node").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, max(1, min(3, depth))):
        front = seen.where(F.col("depth") == d - 1).select("query_id", "node")
        front = front.join(plain, "node", "left_semi") if d > 1 else front
        new = front.join(ways, "node").select("query_id", F.col("other").alias("node")).distinct().join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti")
        seen = cut(seen.unionByName(new.withColumn("depth", F.lit(d))))
    front = seen.where("depth = 0").unionByName(seen.where("depth > 0").join(plain, "node", "left_semi").select(*seen.columns)).select("query_id", "node")
    found = front.join(edges, F.col("node") == F.col("source")).drop("node").unionByName(front.join(edges, F.col("node") == F.col("target")).drop("node"))
    found = found.dropDuplicates(["query_id", "source", "predicate", "target"])
    found = found.join(hubs.select(F.col("node").alias("source"), F.lit(True).alias("s")), "source", "left").join(hubs.select(F.col("node").alias("target"), F.lit(True).alias("t")), "target", "left")
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "source", "predicate", "target")
    return found.where("s is null or t is null").drop("s", "t").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def graph_chunks(edges: DataFrame, mentions: DataFrame, start: DataFrame, cap: int = D.chunk_cap) -> DataFrame:
    """(query_id, chunk_id, seq) in order of first sight: chunks of the edges, then of the seeds' mentions (12, or 20 where a
    question has no edges); each chunk once, ``cap`` at most. ``edges`` are those of ``hops``."""
    by_edge = edges.select("query_id", (F.col("rank") * 1000).alias("at"), F.posexplode("chunks").alias("place", "chunk_id")).select("query_id", "chunk_id", (F.col("at") + F.col("place")).cast("long").alias("at"))
    linked = edges.select("query_id").distinct().withColumn("linked", F.lit(True))
    seeds = start.join(mentions.select(F.col("id").alias("node"), "chunk_id"), "node").select("query_id", "chunk_id").distinct()
    seeds = seeds.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).join(linked, "query_id", "left").where("n <= case when linked then 12 else 20 end")
    every = by_edge.unionByName(seeds.select("query_id", "chunk_id", (F.lit(1 << 40) + F.col("n")).cast("long").alias("at")))
    first = every.groupBy("query_id", "chunk_id").agg(F.min("at").alias("at"))
    return first.withColumn("seq", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "chunk_id"))).where(F.col("seq") <= cap).select("query_id", "chunk_id", "seq")


def widened(edges: DataFrame, mentions: DataFrame, start: DataFrame, cap: int = 10) -> DataFrame:
    """(query_id, chunk_id, seq): chunks that mention neighbours of the seeds, those of the strongest first."""
    near = graph.both_ways(edges).join(start, "node").groupBy("query_id", F.col("other").alias("node")).agg(F.sum(F.coalesce("weight", F.lit(1))).alias("strength"))
    near = near.join(start, ["query_id", "node"], "left_anti")
    hit = near.join(mentions.select(F.col("id").alias("node"), "chunk_id"), "node").groupBy("query_id", "chunk_id").agg(F.max("strength").alias("strength"))
    return hit.withColumn("seq", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("strength"), "chunk_id"))).where(F.col("seq") <= cap).select("query_id", "chunk_id", "seq")


@dataclass(frozen=True)
class Corpus:
    """What the routes read. ``search`` gives (query_id, chunk_id, score, rank) of (query_id, question); a corpus without a
    graph has no entities."""

    search: object
    chunks: DataFrame
    entities: DataFrame | None = None
    edges: DataFrame | None = None
    mentions: DataFrame | None = None


def split_question(question: Column, most: int = 4) -> Column:
    """The default decomposition: parts of a question at commas, semicolons and 'and', longer than five characters."""
    parts = F.filter(F.transform(F.split(question, r"(?i)[;?,]|\band\b|\bversus\b|\bvs\b"), T.squeezed), lambda p: F.length(p) > 5)
    return F.when(F.size(parts) > 1, F.slice(parts, 1, most)).otherwise(F.array().cast("array<string>"))


def vector_hits(corpus: Corpus, questions: DataFrame, k: int = D.top_k) -> DataFrame:
    return corpus.search(questions, k).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("seq"), F.lit("vector").alias("origin"))


def graph_hits(corpus: Corpus, questions: DataFrame) -> DataFrame:
    start = cut(starts(questions, corpus.entities))
    found = graph_chunks(cut(hops(corpus.edges, corpus.entities, start)), corpus.mentions, start)
    return found.select("query_id", "chunk_id", F.lit(D.graph_score).alias("score"), F.col("seq").cast("long").alias("seq"), F.lit("graph").alias("origin"))


def pooled(*lists: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, seq, origin): each chunk of a question once with its best score, best first."""
    every = None
    for n, part in enumerate(lists):
        part = part.withColumn("seq", F.col("seq") + n * 1_000_000)
        every = part if every is None else every.unionByName(part)
    one = R.merged(every, "chunk_id", keys=("query_id",))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq", "chunk_id")
    return one.select("query_id", "chunk_id", "score", F.row_number().over(order).cast("long").alias("seq"), "origin")


def multihop_hits(corpus: Corpus, questions: DataFrame, parts: Column | None = None) -> DataFrame:
    """The question and its parts, each with its own depth, pooled for the question."""
    split = split_question(F.col("question")) if parts is None else parts
    asked = questions.withColumn("parts", split).select("query_id", "question", F.posexplode(F.concat(F.array("question"), "parts")).alias("n", "part"), F.size("parts").alias("more"))
    each = asked.select(F.struct("query_id", "n").alias("query_id"), F.col("part").alias("question"))
    depth = F.greatest(F.lit(4), F.floor(F.lit(D.top_k) / F.greatest(F.col("more"), F.lit(1))) + 2)
    hits = corpus.search(each, D.top_k).select("query_id.*", "chunk_id", "score", "rank").join(asked.select("query_id", "n", depth.alias("depth")), ["query_id", "n"])
    return hits.where(F.col("rank") <= F.col("depth")).select("query_id", "chunk_id", "score", (F.col("n") * 1000 + F.col("rank")).cast("long").alias("seq"), F.lit("multihop").alias("origin"))


def retrieved(corpus: Corpus, questions: DataFrame, k: int = D.top_k, parts: Column | None = None) -> DataFrame:
    """The pools of questions (query_id, question, route): by vectors and BM25; with chunks of the graph (GRAPH, HYBRID); with
    the question's parts (MULTIHOP; as HYBRID where it has none). A question that the graph says nothing about keeps its
    search hits; DIRECT retrieves nothing; without a graph all routes search."""
    ask = lambda routes: questions.where(F.col("route").isin(*routes)).select("query_id", "question")
    plain = vector_hits(corpus, ask(("VECTOR", "GRAPH", "HYBRID")), k)
    several = multihop_hits(corpus, ask(("MULTIHOP",)), parts)
    if corpus.entities is None:
        return pooled(plain, several)
    return pooled(plain, several, graph_hits(corpus, ask(("GRAPH", "HYBRID", "MULTIHOP"))))


def pool_counts(pool: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunks, documents) of each pool."""
    return pool.join(chunks.select("chunk_id", "doc_id"), "chunk_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("documents"))


def promoted(before: Column, after: Column, top: int = 5) -> Column:
    """How many of the new first ones weren't among the old first ones."""
    return F.size(F.array_except(F.slice(after, 1, top), F.slice(before, 1, top)))
