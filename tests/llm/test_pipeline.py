"""The pipeline on planted cases, and connected components against a plain search."""

import random

import pytest

from siltstone.llm.components import components

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


def planted(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(20) + ". " + text(12) + ".") for i in range(20)]
    passage = text(90)
    docs, kind = [], {}

    def add(t, k):
        kind[len(docs)] = k
        docs.append(t)

    for _ in range(200):
        add(text(rng.randint(40, 120)), "clean")
    for i in range(60):
        words = text(40).split()
        for _ in range(3):
            words.insert(rng.randrange(40), rng.choice(["vileword", "rottenword"]))
        add(" ".join(words), "toxic")
    for i in range(5):
        base = text(150).split()
        add(" ".join(base), "first")
        add(" ".join(base), "copy")
        near = list(base)
        near[70] = "other"
        add(" ".join(near), "copy")
    for i in range(4):
        add(text(60) + " " + passage + " " + text(60), "passage")
    for i in range(5):
        add(text(50) + " " + items[i][1] + " " + text(50), "leak")
    return docs, kind, items, passage


def test_pipeline_on_planted_cases(spark, tmp_path):
    docs, kind, items, passage = planted()
    rows = [(i, t, "en", "src", len(t), "x") for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sig string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(kind[i] == "toxic")) for i in range(0, len(docs), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    start = spark.read.parquet(f"{tmp_path}/documents.parquet")
    frame, seen = start, []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(frame)
    assert all(f.columns == start.columns for f in seen[:-1])
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in seen]
    of = lambda k: {i for i, x in kind.items() if x == k}
    assert ids[0] == set(kind) - of("toxic")
    assert ids[1] == ids[0] - of("copy")
    assert ids[2] == ids[1] and ids[3] == ids[2] - of("leak") and ids[4] == ids[3]
    final = {r.doc_id: r for r in seen[-1].collect()}
    for i in of("clean") | of("first"):
        assert final[i].text == docs[i] and final[i].n_tokens == len(final[i].ids)
    for i in of("passage"):
        before, after = docs[i].split(passage)  # letters next to the passage go with it where two documents share them
        rest = final[i].text
        assert passage not in rest and rest.startswith(before[:-6]) and rest.endswith(after[6:]) and len(before + after) - 12 <= len(rest) <= len(before + after)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_go_through_all_stages(spark, edge_rows, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and ids, columns with the names that the stages use themselves."""
    own = ("sig", "h", "data", "hit", "root", "component_id", "n_shingles", "item", "severity", "leak", "name", "times", "__id", "__sig", "__kept", "__own", "__hit", "__text", "__leaks_0", "__severity", "a.b", "c`d", "row", "id", "y", "t", "label", "firsts")
    long = [(900, "one long word after another " * 20_000), (901, "x" * 300_000)]
    rows = [(i, t, None, "s", None if t is None else len(t), *own) for i, t in [r[:2] for r in edge_rows] + long]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in own))
    spark.createDataFrame([(1, 1, None), (None, 0, 1), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, seen = docs.repartition(3), []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(frame.collect())
    assert docs.count() == len(seen[0])  # one kind of label alone: nothing is toxic
    ids = [{r.doc_id for r in f} for f in seen]
    assert all(r.asDict()[c] == c for f in seen[:-1] for r in f for c in own)
    # every text without words stays, texts that stand in several rows stay once
    wordless = {i for i, t in (r[:2] for r in edge_rows) if not (t or "").split()}
    assert wordless <= ids[1] and None in ids[1] and {900, 901} <= ids[1]
    texts = [r.text for r in seen[1] if r.text and r.text.split()]
    assert len(texts) == len(set(texts))
    # what repeats within a text goes too
    kept = {r.doc_id: r for r in seen[2]}
    assert kept[900].text == "" and kept[901].text == "" and ids[2] == ids[1]
    assert all(r.text is None or r.n_chars == len(r.text) for r in seen[2])
    assert {r.doc_id for r in seen[4]} == ids[3] and all(r.n_tokens == len(r.ids) for r in seen[4])


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for a, b in links if a != b for x in (a, b)}
    assert {(r.node, r.root) for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_short_passages_of_over_50_words_go(spark):
    """Passages of 51 to 62 words and under 400 bytes, those of 50 words, and lines that repeat in unlike places."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    gone = [text(n) for n in (51, 55, 58, 62)] + [" ".join(rng.choice("abcdefghijklm") for _ in range(51))]
    assert all(len(p) < 400 for p in gone) and len(gone[-1]) == 101
    short, lines, twice = text(50), [text(30) for _ in range(4)], text(55)
    rows, want = [], []

    def add(t, rest=None):
        rows.append((len(rows), t, len(t), "x"))
        want.append(t if rest is None else rest)

    for passage in gone:
        for k in range(3):
            before, after = f"start {k} " + text(30), f"{k} end, " + text(30)
            add(f"{before} ({passage}). {after}", f"{before} (). {after}")
    for k in range(3):
        add(f"{text(20)} {k}, {short}; {k} {text(20)}")
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)):  # 60 words of repeated lines, but no 51 of them in the same order elsewhere
        add(f"{a} {lines[a]} {b} {lines[b]} {a}")
    add(f"{text(20)} 1 {twice} 2 {twice} 3")  # under 400 bytes and in one text alone
    add("", "")
    rows.append((None, None, None, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, sig string").repartition(3)
    out = corpus_pipeline.repeated_strings_go(spark, docs, "")
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].text for i in range(len(want))] == want and len(got) == len(rows)
    assert all(got[i].n_chars == len(t) and got[i].sig == "x" for i, t in enumerate(want))


def test_unlike_texts_under_one_id_stay(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n))
    a, b, c, d, e = (text(150) for _ in range(5))
    near = lambda t, k: " ".join([*t.split()[:k], "other", *t.split()[k + 1 :]])
    gone = [(9, near(a, 70)), (7, near(b, 70)), (5, a), (5, near(b, 30)), (5, "..."), (3, near(d, 20)), (12, d), (8, e)]
    stay = [(5, c), (6, near(c, 5)[:300]), (3, d), (4, e), (5, ""), (10, "one two"), (10, "three four"), (11, None), (11, "?"), (None, e), (None, e)]
    docs = spark.createDataFrame([*gone[:2], *stay, *gone[3:4], (5, a), *gone[5:], (5, a), (5, b), (5, "..."), (5, ""), (8, near(e, 40)), (11, None)], "doc_id long, text string").repartition(3)
    for frame in (docs, docs.withColumn("doc_id", docs.doc_id.cast("int"))):
        out = corpus_pipeline.one_of_each_group_stays(spark, frame, "")
        assert out.columns == frame.columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        one = lambda some: len([x for x in got if x in some])
        assert one([(5, a)]) == 1 and one([(5, b), (5, near(b, 30))]) == 1 and one([(5, "...")]) == 1
        assert one([(3, d), (3, near(d, 20))]) == 1 and one([(11, None)]) + one([(11, "")]) == 1
        rest = [x for x in stay if x not in [(3, d), (11, None)]]
        assert all(x in got for x in rest) and len(got) == len(rest) + 5


def test_texts_that_stay_are_not_dealt_by_id(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: " ".join(f"{rng.getrandbits(60):x}" for _ in range(1000))
    rows = [(i, text()) for i in range(100)]
    rows += [(200 + i, rows[i][1]) for i in range(3)] + [(50, text()), (None, text())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where ids are too many
    try:
        out = corpus_pipeline.one_of_each_group_stays(spark, docs, "")
        began = shuffled()
        out.write.parquet(f"{tmp_path}/out")
        assert shuffled() - began < sum(len(t) for _, t in rows) / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in docs.where("doc_id is null or doc_id < 200").collect())


def test_workers_get_bounded_bytes_and_give_memory_back(spark, tmp_path):
    """Long texts come in batches of bounded bytes, the sample's features begin without the memos of earlier stages."""
    import pyarrow as pa

    from siltstone.llm import common, toxicity

    def sizes_of(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(i, f"{i} word " * 20_000) for i in range(60)], "doc_id long, text string").coalesce(1)
    spark.createDataFrame([(i, 0) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.toxic_documents_go(spark, docs, str(tmp_path))
    sizes = [r.n for r in out.select("text").mapInArrow(sizes_of, "n long").collect()]
    assert len(sizes) > 1 and max(sizes) < 6 << 20
    made = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "map_column", lambda make, kind: made.append(make) or common.map_column(make, kind))
        toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    common.kept(("memos of another stage",), dict)
    work = made[0]()
    assert not common._KEPT and len(work(["one two", None, ""]).to_pylist()[0]) == 2
