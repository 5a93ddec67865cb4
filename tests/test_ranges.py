"""Range joins, neighbours, ranks and stored answers against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import explore, graph, ranges
from siltstone.sources import files
from siltstone.sources.extractions import Extractions


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_overlaps_meet_once(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.choice(["a", "a", "b", None]), i, lo := round(rng.uniform(-40, 40), 1), lo + round(rng.choice([0, 0, 3, 25, 90]), 1)) for i in range(n)]
    left, right = make(60) + [("a", 99, None, 1.0), ("a", 98, 5.0, 1.0)], make(50)
    a = spark.createDataFrame(left, "k string, i int, lo double, hi double")
    b = spark.createDataFrame(right, "k string, j int, lo double, hi double")
    want = sorted((k, i, j) for k, i, lo, hi in left for q, j, lo2, hi2 in right if k is not None and k == q and lo is not None and lo <= hi and lo <= hi2 and lo2 <= hi)
    for width in (1.0, 7.5, 1000.0):
        assert sorted(map(tuple, ranges.overlapping(a, b, ["k"], width).select("k", "i", "j").collect())) == want


def test_neighbours_over_block_borders(spark):
    rng = random.Random(2)
    made = [(k, at, rng.choice([None, f"t{at}"])) for k in ("a", "b", None) for at in rng.sample(range(-50, 400), 60)]
    df = spark.createDataFrame(made, "k string, at long, a string")
    want = set()
    for k in ("a", "b", None):
        own = sorted((at, v) for key, at, v in made if key == k)
        want |= {(k, at, v, own[i - 1][1] if i else None, own[i + 1][1] if i + 1 < len(own) else None) for i, (at, v) in enumerate(own)}
    for width in (1, 13, 10_000):
        assert set(map(tuple, ranges.neighbours(df, ["k"], "at", F.col("a"), width).collect())) == want
    out = explore.context(df, "k", "at", "a", 9)
    assert out.columns == ["k", "at", "a", "context_before", "context_after"] and set(map(tuple, out.collect())) == want


def test_as_of_takes_the_newest_mark(spark):
    rng = random.Random(3)
    left = [(rng.choice("ab"), rng.randrange(300), i) for i in range(80)]
    marks = [(rng.choice("abc"), rng.randrange(300), rng.randrange(9)) for _ in range(25)]
    a, m = spark.createDataFrame(left, "k string, d long, i int"), spark.createDataFrame(marks, "k string, d long, mark long")
    want = set()
    for k, d, i in left:
        best = max(((e, v) for q, e, v in marks if q == k and e <= d), default=(None, None))
        want.add((k, d, i, *best))
    for width in (1, 40, 1000):
        assert set(map(tuple, ranges.as_of(a, m, ["k"], "d", width).collect())) == want


@pytest.mark.parametrize("most", [1, 9, 70_000, 1 << 40])
def test_ranks_by_narrowing_bins(spark, most):
    rng = random.Random(most)
    made = [(k, rng.choice([0, most, rng.randrange(most + 1)])) for k in ("a", "b", None) for _ in range(rng.randint(1, 40))] + [("c", None)]
    df = spark.createDataFrame(made, "k string, n long")
    for rank, at in ((F.floor(F.col("n") / 2) + 1, lambda v: v[len(v) // 2]), (F.lit(1), min), (F.col("n"), max)):
        want = [(k, at(sorted(n for q, n in made if q == k))) for k in ("a", "b")]
        assert [r for r in rows(ranges.ranked(df, ["k"], "n", rank)) if r[0]] == want
    assert ranges.ranked(df.where("n is null"), ["k"], "n", F.lit(1)).count() == 0
    hub = graph.hub_thresholds(df.where("k is not null"), ["k"], "n").collect()
    assert all(r.hub_at >= 10 for r in hub) and len(hub) == 2


def test_titles_and_captions_of_a_page(spark):
    items = spark.createDataFrame([(1, 1, 10.0, 200.0), (2, 1, 300.0, 200.0), (3, 2, 10.0, 50.0)], "item int, page int, x0 double, y0 double")
    titles = spark.createDataFrame([(1, 12.0, 190.0, "near"), (1, 10.0, 130.0, "far"), (1, 10.0, 201.0, "below"), (2, 10.0, -60.0, "too far")], "page int, x0 double, y1 double, title string")
    assert rows(explore.nearest_above(items, titles)) == [(1, "near")]
    images = spark.createDataFrame([(1, 1, 100.0, 200.0), (2, 2, 0.0, 10.0)], "image int, page int, y0 double, y1 double")
    texts = spark.createDataFrame([(1, 205.0, 215.0, "plain words"), (1, 60.0, 70.0, "Figure 3. The engine"), (1, 340.0, 350.0, "Figure 9. Too far"), (2, 500.0, 510.0, "Figure 1. Elsewhere")], "page int, y0 double, y1 double, text string")
    assert rows(explore.nearest_caption(images, texts)) == [(1, "Figure 3. The engine")]


def test_a_second_run_asks_nothing(spark, tmp_path):
    def ask(texts, log=f"{tmp_path}/asked"):
        with open(log, "a") as f:
            f.write("".join(f"{len(texts)} {t}\n" for t in texts))
        if any("bad" in t for t in texts):
            raise ValueError("no answer")
        return [None if "silent" in t else t.upper() for t in texts]

    store = Extractions(spark, f"file://{tmp_path}/x", "v1")
    made = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None), (5, ""), (6, "silent")], "id long, text string").repartition(3)
    want = [(1, "ONE"), (2, "TWO"), (3, "ONE"), (4, None), (5, None), (6, None)]
    assert rows(store.answers(made, ask, batch=2).select("id", "answer")) == want
    first = open(f"{tmp_path}/asked").read().split("\n")[:-1]
    assert sorted(x.split()[1] for x in first) == ["one", "silent", "two"] and all(int(x.split()[0]) <= 2 for x in first)
    again = Extractions(spark, f"file://{tmp_path}/x", "v1")
    assert rows(again.answers(made.where("id <> 6"), ask).select("id", "answer")) == want[:5]
    assert open(f"{tmp_path}/asked").read().split("\n")[:-1] == first
    more = spark.createDataFrame([(7, "bad"), (8, "three"), (9, "one")], "id long, text string")
    assert rows(again.answers(more, ask, batch=1).select("id", "answer")) == [(7, None), (8, "THREE"), (9, "ONE")]
    assert again.evict(more) == 1 and rows(again.stored().select("answer")) == [("ONE",), ("THREE",)]


def test_content_store_keeps_what_is_there(spark, tmp_path):
    make = lambda *c: spark.createDataFrame([(f"/{i}", bytearray(x)) for i, x in enumerate(c)], "path string, content binary")
    path = f"file://{tmp_path}/media"
    assert files.store_by_content(make(b"a", b"a", b"b"), path).count() == 3
    files.store_by_content(make(b"c", b"a"), path)
    assert sorted(bytes(r.content) for r in files.stored_content(spark, path).collect()) == [b"a", b"b", b"c"]
    assert spark.read.parquet(path).count() == 3
