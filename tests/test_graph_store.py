"""The stored graph against graphs made anew from what is left."""

import random
import re

from pyspark.sql import functions as F

from siltstone.operators import graph
from siltstone.sources import graph_store
from siltstone.sources.graph_store import GraphStore


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def said(spark, seed, docs):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(30)]
    mentions, relations = [], []
    for d in docs:
        own = rng.sample(names, 4) + ["n0"] * 3
        mentions += [(x, d, i, x.upper(), rng.choice(["OTHER", "ORG"]), rng.choice(["", "a note"]), 1) for i, x in enumerate(own)]
        relations += [(a, rng.choice("PQ"), b, d, 1) for a, b in zip(own, own[1:], strict=False)]
    mentions += [("", docs[0], 9, "", "", "", 1), ("n1", None, 9, "N1", "ORG", "", 1)]
    relations += [("", "P", "n1", docs[0], 1), ("n1", "P", "n1", docs[0], 1)]
    return spark.createDataFrame(mentions, "node string, doc_id long, seq long, name string, kind string, description string, n long"), spark.createDataFrame(relations, "source string, predicate string, target string, doc_id long, n long")


def test_upserts_replacements_and_deletions(spark, tmp_path):
    (m1, r1), (m2, r2) = said(spark, 1, range(12)), said(spark, 2, range(9, 15))
    store = GraphStore.create(spark, f"file://{tmp_path}/g", buckets=8).upsert(m1, r1, "a").upsert(m1, r1, "a")
    old = store.commits.manifest()
    before = rows(store.edges())
    store.upsert(m2, r2, "b", replace=True).delete(spark.sql("select explode(array(2L, 11L, 99L)) as doc_id"), "c")
    left = lambda a, b: a.where("doc_id < 9 and doc_id <> 2").unionByName(b.where("doc_id <> 11"))
    m, r = left(m1, m2).where("node <> ''"), left(r1, r2)
    want = rows(graph.upsert_relations(r).select("source", "predicate", "target", "weight"))
    counts = m.groupBy("node").agg(F.count("*").alias("mentions"))
    for _ in range(2):
        assert rows(store.edges()) == want
        assert rows(store.entities().select("node", "mentions")) == rows(counts)
        start = spark.sql("select 'n3' as node")
        full = graph.khop_edges(graph.upsert_relations(r).select("source", "target", "predicate", "weight"), counts, start, 2, None)
        assert rows(store.khop(start, 2, None)) == rows(full.select("source", "target", "predicate", "weight"))
        assert store.khop(start, 2, 3).count() == 3
        store.compact()
    assert rows(store.edges(manifest=old)) == before  # a snapshot
    store.commits.vacuum()
    assert rows(store.edges()) == want


def test_reads_go_to_the_buckets_of_the_frontier(spark, tmp_path):
    m, r = said(spark, 3, range(10))
    store = GraphStore.create(spark, f"file://{tmp_path}/g", buckets=16).upsert(m, r)
    start = spark.sql("select 'n3' as node")
    plan = store.adjacent(start)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ (=|IN)", plan), plan
    bucket = start.select(store.bucket(16)).first()[0]
    read = store.adjacent(start).select(F.lit(1))
    assert {r.bucket for r in store.commits.read("edges", "node string, bucket int").where("node = 'n3'").distinct().collect()} == {bucket} and read.count() > 0
    assert rows(store.adjacent(start).select("node").distinct()) == [("n3",)]


def test_extraction_goes_into_the_store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ada Lovelace met Charles Babbage in London."), (2, "Charles Babbage left London."), (3, None)], "doc_id long, text string")
    found = graph.extracted(docs, "doc_id", "text")
    store = graph_store.written(GraphStore.create(spark, f"file://{tmp_path}/g"), found, graph.co_mentions(found))
    graph_store.written(store, found, graph.co_mentions(found))  # read anew: documents take their own place
    entities, relations = graph_store.rebuilt(store)
    assert rows(entities.select("norm_name", "mentions")) == rows(graph.upsert_entities(found).select("norm_name", "mentions"))
    assert rows(relations) == rows(graph.upsert_relations(graph.co_mentions(found)).select("source", "predicate", "target", "weight", "n_docs"))
