"""The stored index: commits that are killed and repeated, snapshots, conflicts; pruned searches against whole ones."""

import os
import random

import numpy as np
import pytest

from siltstone.operators import retrieval as R
from siltstone.sources.commits import Commits, Conflict
from siltstone.sources.index import Index


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def texts(spark, seed=1, n=700):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(120)]
    made = [(i, " ".join(rng.choices([f"w{k}" for k in range(120)], weights, k=rng.randint(0, 60)))) for i in range(n)]
    return spark.createDataFrame(made + [(n, None), (n + 1, "w3 " * 300)], "chunk_id long, text string")


def asked(spark):
    return spark.createDataFrame([(1, "w0 w1 w90"), (2, "w2 w100 w101 w119"), (3, "nothing here"), (4, ""), (5, "w0"), (6, " ".join(f"w{k}" for k in range(120)))], "query_id long, question string")


class Killed(Exception):
    pass


def test_an_upsert_killed_between_its_writes_can_be_repeated(spark, tmp_path, monkeypatch):
    docs = texts(spark, n=60)
    want = Index.create(spark, f"file://{tmp_path}/whole", 0).upsert(docs).upsert(docs.where("chunk_id < 9"))
    for kill in range(1, 4):
        index = Index.create(spark, f"file://{tmp_path}/{kill}", 0).upsert(docs)
        before = rows(index.bm25(asked(spark)))
        write, done = Index._write, []

        def dies(self, *a, kill=kill, write=write, done=done):
            if len(done) == kill:
                raise Killed
            done.append(1)
            return write(self, *a)

        monkeypatch.setattr(Index, "_write", dies)
        if kill < 3:
            with pytest.raises(Killed):
                index.upsert(docs.where("chunk_id < 9"), token="t")
        else:  # all is written, but the manifest isn't
            monkeypatch.setattr(Commits, "publish", lambda *a, **b: (_ for _ in ()).throw(Killed()))
            with pytest.raises(Killed):
                index.upsert(docs.where("chunk_id < 9"), token="t")
        monkeypatch.undo()
        assert rows(index.bm25(asked(spark))) == before
        index.upsert(docs.where("chunk_id < 9"), token="t").upsert(docs.where("chunk_id < 9"), token="t")
        assert index.commits.manifest()["version"] == 3 and rows(index.bm25(asked(spark))) == rows(want.bm25(asked(spark)))
        assert index.commits.vacuum() == kill and rows(index.bm25(asked(spark))) == rows(want.bm25(asked(spark)))


def test_snapshots_and_conflicts(spark, tmp_path):
    index = Index.create(spark, f"file://{tmp_path}/i", 0).upsert(texts(spark, n=20))
    old = index.manifest()
    index.delete(spark.sql("select 3L as chunk_id"))
    assert index.lengths().count() == index.lengths(old).count() - 1 == index.count()
    with pytest.raises(Conflict):
        index.commits.publish(old, {}, old["info"])
    assert index.commits.versions() == [1, 2, 3]


def test_pruned_search_equals_a_whole_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("siltstone.sources.index.BLOCK", 4)
    monkeypatch.setattr("siltstone.sources.index.SLICE", 200)
    docs = texts(spark).fillna("")
    index = Index.create(spark, f"file://{tmp_path}/i", 0, 4).upsert(docs)
    full = R.bm25(docs, asked(spark), "chunk_id", "text", "query_id", "question").withColumnRenamed("doc_id", "chunk_id")
    for k in (1, 5, 12):
        want = rows(R.top_k(full.selectExpr("query_id", "chunk_id", "round(score, 6) AS score"), "chunk_id", k))
        assert rows(index.top(asked(spark), k).select("query_id", "chunk_id", "score", "rank")) == want
    read, every = index.share_read(asked(spark).where("query_id in (2, 5)"), 3)
    assert 0 < read < every
    assert index.plan(asked(spark), 100) is None
    again = rows(index.upsert(docs.where("chunk_id < 50")).top(asked(spark), 5))
    assert again == rows(index.compact().top(asked(spark), 5)) and index.plan(asked(spark), 5) is not None


@pytest.mark.parametrize("but_self", [True, False])
def test_dense_top_is_brute_force(spark, but_self):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (300, 6)).astype(float)
    x[100:220] = x[100]  # one vector in two rows of five
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "item long, embedding array<double>").repartition(5)
    queries = made.where("item % 10 = 0").selectExpr("item AS query_id", "embedding AS query_vector")
    got = R.dense_top(made, queries, 7, but_self, most=11)
    want = []
    for q in range(0, 300, 10):
        found = sorted((-round(float(x[q] @ x[i]), 6), i) for i in range(300) if i != q or not but_self)[:7]
        want += [(q, i, -s, k) for k, (s, i) in enumerate(found, 1)]
    assert sorted((r.query_id, r["item"], r.score, r["rank"]) for r in got.collect()) == sorted(want)
    assert R.dense_top(made, queries.limit(0)).count() == 0 and R.dense_top(made.limit(0), queries).count() == 0


@pytest.mark.parametrize("scaled", [True, False])
def test_dense_ranked_is_all_pairs_by_rank(spark, scaled):
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 41, (200, 4)) / 256  # scores that lie between two of six places
    x[60:140] = x[60]
    plain = [(i - 20, v.tolist()) for i, v in enumerate(x)]
    odd = [(300, None), (301, [float("nan"), 0.0, 1.0, 1.0]), (310, [None, 1.0, 1.0, 1.0]), (311, [float("inf"), 1.0, 0.0, 0.0]), (-30, None)]
    scale = 1 + R.F.col("item") % 7 if scaled else None
    for rows_ in (plain, plain + odd, plain[:3] + odd, odd[:1]):
        made = spark.createDataFrame(rows_, "item long, embedding array<double>").repartition(5)
        queries = made.where("item % 10 = 0").selectExpr("item AS query_id", "embedding AS query_vector")
        every = R.dense(made, queries, "item", "embedding").withColumnRenamed("vec_id", "item")
        every = every.withColumn("score", R.F.round(R.F.col("score") * scale, 6)) if scaled else every
        for k in (1, 9):
            got = R.dense_ranked(made, queries, k, scale).select("query_id", "item", "score", "rank")
            assert str(rows(got)) == str(rows(R.top_k(every, "item", k).select("query_id", "item", "score", "rank")))  # NaN is not itself


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not there")
@pytest.mark.parametrize("name", ["exclude_seen", "multi_query_merge", "rescale_blend_rerank"])
def test_rankings_make_no_row_for_each_pair(spark, name):
    from siltstone.plans import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "MapInArrow" in plan


def test_tasks_send_bounded_lists():
    s, v = R.smallest_of_equals(np.array([1.0, 2.0, 1.0, 1.0, 2.0]), np.array([5, 9, 1, 3, 2]), 2)
    assert s.tolist() == [2.0, 2.0, 1.0, 1.0] and v.tolist() == [2, 9, 1, 3]


def test_odd_letters_nulls_and_repeated_ids(spark, tmp_path):
    made = [(1, "K2 İx Ab-c ÉÀ a K9K"), (None, "a b"), (2, "a a"), (2, "z a"), (3, None), (None, "a c c"), (4, "--"), (-5, "i x k2 c")]
    docs = spark.createDataFrame(made, "chunk_id long, text string").repartition(3)
    one = spark.createDataFrame([(i, t or "") for i, t in made if t not in ("a b", "a a")], "chunk_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (77, [1.0, 1.0])], "chunk_id long, embedding array<float>")
    index = Index.create(spark, f"file://{tmp_path}/i", 2, 4).upsert(docs, vectors=vectors)
    assert rows(index.lengths().select("chunk_id", "dl")) == rows(one.select("chunk_id", R.F.size(R.terms(R.F.col("text"))).alias("dl")))
    assert rows(index.vectors()) == [(1, [2.0, 0.0])]
    asked = spark.createDataFrame([((7, 1), "k2 a I"), ((7, 2), "c İ nowhere"), ((7, 3), "")], "query_id struct<a: int, b: int>, question string")
    full = R.bm25(one, asked, "chunk_id", "text", "query_id", "question").withColumnRenamed("doc_id", "chunk_id")
    for k in (1, 9):
        assert rows(index.top(asked, k).select("query_id", "chunk_id", "score", "rank")) == rows(R.top_k(full.selectExpr("query_id", "chunk_id", "round(score, 6) AS score"), "chunk_id", k))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not there")
def test_the_corpus_is_written_once_and_searches_send_no_row_for_a_posting(spark, tmp_path, monkeypatch):
    from siltstone.plans import queries_kb

    wrote, write = [], Index._write
    monkeypatch.setattr(Index, "_write", lambda self, rows, table, *a: wrote.append(table) or write(self, rows, table, *a))
    monkeypatch.setattr(queries_kb, "folder", lambda spark: f"file://{tmp_path}")
    index = queries_kb.corpus_index(spark, "/root/testdata/sf0.001")
    assert sorted(wrote) == ["lengths", "postings", "terms", "vectors"] and index.meta()["gens"] == 1
    found = index.top(queries_kb.questions(spark, "/root/testdata/sf0.001"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and found.count() > 0


def test_hybrid_searches_once(spark, tmp_path):
    docs = texts(spark, n=40).fillna("")
    vectors = docs.select("chunk_id", R.F.array(R.F.col("chunk_id").cast("float"), R.F.lit(1.0).cast("float")).alias("embedding"))
    index = Index.create(spark, f"file://{tmp_path}/i", 2, 4).upsert(docs, vectors=vectors)
    found = index.hybrid(asked(spark).withColumn("query_vector", R.F.array(R.F.lit(1.0), R.F.lit(0.0))), 3)
    assert "InArrow" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 18
