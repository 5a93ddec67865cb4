"""Hand-made cases of the stored index, routed retrieval, the explorer and the ingest."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import evidence, explore, explorer
from siltstone.operators import retrieval as R
from siltstone.plans import answering, ingesting
from siltstone.sources import files
from siltstone.sources.index import Index


@pytest.fixture(scope="module")
def graph_tables(spark):
    names = {1: "Acme Works", 2: "Borealis Fund", 3: "Cedar River", 4: "Delta Port", 5: "Ember Hub"}
    entities = spark.createDataFrame([(i, n.lower(), n, "", 500 if i == 5 else 3) for i, n in names.items()], "id long, norm_name string, name string, description string, mentions long")
    edges = spark.createDataFrame([(1, "OWNS", 2, 3, [10, 11]), (2, "FUNDS", 3, 2, [11, 12]), (3, "NEAR", 4, 1, [13]), (1, "SEES", 5, 9, [14]), (5, "SEES", 4, 9, [15])], "source long, predicate string, target long, weight long, chunks array<long>")
    mentions = spark.createDataFrame([(1, 20), (1, 10), (2, 21), (3, 22), (4, 23), (5, 24)], "id long, chunk_id long")
    return entities, edges, mentions


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_seeds_allow_one_edit_and_fall_back_to_parts_of_names(spark, graph_tables):
    asked = spark.createDataFrame([(1, "How is Acma linked to the fund?"), (2, "What of the riv mouth?"), (3, "nothing here")], "query_id long, question string")
    found = evidence.found_seeds(asked, graph_tables[0])
    assert {(r.question_id, r.id) for r in found.collect()} == {(1, 1), (1, 2), (2, 3)}


def test_hops_stop_at_hubs_and_end_in_chunks(spark, graph_tables):
    entities, edges, mentions = graph_tables
    start = spark.createDataFrame([(7, 1), (8, 4)], "query_id long, node long")
    found = evidence.hops(edges, entities.select("id", "mentions"), start)
    assert {(r.query_id, r.source, r.target) for r in found.collect()} == {(7, 1, 2), (7, 2, 3), (7, 1, 5), (8, 3, 4), (8, 2, 3), (8, 5, 4)}
    got = {q: [r.chunk_id for r in sorted(evidence.graph_chunks(found, mentions, start).collect(), key=lambda r: r.seq) if r.query_id == q] for q in (7, 8)}
    assert got == {7: [14, 10, 11, 12, 20], 8: [15, 11, 12, 13, 23]}
    lone = spark.createDataFrame([(9, 3)], "query_id long, node long")
    none = evidence.hops(edges.where("source > 90"), entities.select("id", "mentions"), lone)
    assert rows(evidence.graph_chunks(none, mentions, lone)) == [(9, 22, 1)]
    assert rows(evidence.widened(edges, mentions, lone)) == [(9, 21, 1), (9, 23, 2)]


def test_routes(spark, graph_tables):
    chunks = spark.createDataFrame([(10, "acme works owns the borealis fund"), (12, "cedar river lies far away"), (20, "acme again"), (30, "unrelated words on tides")], "chunk_id long, text string")
    corpus = answering.scanned(chunks)
    corpus = evidence.Corpus(corpus.search, chunks, *graph_tables)
    ask = [(1, "acme works", "VECTOR"), (2, "Acme Works", "GRAPH"), (3, "tides and acme works", "MULTIHOP"), (4, "hello", "DIRECT"), (5, "tides", "HYBRID")]
    found = evidence.retrieved(corpus, spark.createDataFrame(ask, "query_id long, question string, route string")).collect()
    by = {q: {(r.chunk_id, r.origin) for r in found if r.query_id == q} for q in range(1, 6)}
    assert by[1] == {(10, "vector"), (20, "vector")} and by[4] == set() and by[5] == {(30, "vector")}
    assert {c for c, _ in by[2]} >= {10, 20, 14, 11, 12} and ("graph" in {o for _, o in by[2]})
    assert {c for c, _ in by[3]} >= {30, 10, 20}
    split = spark.sql("select 'the tides of Rio and the port of Oslo?' as q").select(evidence.split_question(F.col("q"))).first()[0]
    assert split == ["the tides of Rio", "the port of Oslo"]


def test_answers_stop_and_come_back_to_the_better_window(spark):
    chunks = spark.createDataFrame([(1, "the alpha turbine has nine blades"), (2, "beta gardens open in may"), (3, "gamma")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "alpha turbine blades"), (2, "alpha kites zeppelins"), (3, "hello")], "query_id long, question string")
    out = {r.query_id: r for r in answering.answer(chunks, asked, passes=3).collect()}
    assert out[1].sufficient and out[1].passes == 1 and out[1].answer.startswith("the alpha turbine")
    assert out[2].note == "nothing further was found" and out[2].passes == 2 and out[3].route == "DIRECT" and out[3].answer == ""

    class Worse(answering.Models):
        def sufficiency(self, question, evidence_):
            return F.when(F.contains(evidence_, F.lit("gamma")), 0.1).otherwise(0.5)

        def hypothesis(self, question):
            return F.lit("gamma and nothing but gamma, over and over again, gamma")

    out = answering.answer(chunks, asked.where("query_id = 2"), Worse(), passes=3).first()
    assert out.score == 0.5 and out.passes == 2 and out.answer.startswith("the alpha turbine")

    class Rewrites(answering.Models):
        def rewritten(self, question, history):
            return F.concat(F.lit("alpha "), question)

    past = spark.createDataFrame([(1, "User: tell me of alpha")], "query_id long, history string")
    ask = spark.createDataFrame([(1, "how many blades has it"), (2, "how many blades has it")], "query_id long, question string")
    assert rows(answering.condensed(ask, past, Rewrites()).select("query_id", "question")) == [(1, "alpha how many blades has it"), (2, "how many blades has it")]


def test_loop_budget_prompt_profile_and_condense(spark):
    chunks = spark.createDataFrame([(1, "the alpha turbine has nine blades", "a.md", 3), (2, "the beta pump is blue", "b.md", None)], "chunk_id long, text string, filename string, page_no int")
    asked = spark.createDataFrame([(1, "how many blades has the alpha turbine"), (2, "which colour has the gamma engine of the alpha works")], "query_id long, question string")
    past = spark.createDataFrame([(3, "User: tell me about the alpha turbine\nAssistant: it turns")], "query_id long, history string")
    lean = spark.createDataFrame([(3, "how many blades has it")], "query_id long, question string")
    out = {r.query_id: r for r in answering.answer(chunks, asked.unionByName(lean), history=past, profile=spark.createDataFrame([("a.md", 1), ("b.md", 2)], "filename string, seq int")).collect()}
    assert out[1].calls == 1 and "[1] a.md, page 3\nthe alpha turbine has nine blades" in out[1].prompt and out[1].prompt.startswith("Question: how many")
    assert out[3].calls >= 2 and "(" in out[3].prompt.split("\n")[0] and "turbine" in out[3].prompt.split("\n")[0] and "nine blades" in out[3].answer
    one = {r.query_id: r for r in answering.answer(chunks, asked, budget=(6, 1, 1e9)).collect()}
    assert one[2].passes == 1 and one[2].note == "fast calls spent" and one[2].prompt.startswith("The evidence is thin")
    late = {r.query_id: r for r in answering.answer(chunks, asked, budget=(6, 12, 0.0)).collect()}
    assert late[2].passes == 1 and late[2].note == "time spent"
    assert answering.described(spark.createDataFrame([(f"f{i}", i) for i in range(9)], "filename string, seq int")) == "f0, f1, f2, f3, f4, f5 and 3 more"


def test_index_guard_writes_and_search(spark, tmp_path):
    index = Index.create(spark, f"file://{tmp_path}/i", 2)
    docs = spark.createDataFrame([(1, "red apple", [1.0, 0.0]), (2, "green apple", [0.0, 1.0]), (2, "a", [0.5, 0.5]), (3, None, [1.0, 1.0])], "chunk_id long, text string, v array<double>")
    index.upsert(docs, vector="v")
    with pytest.raises(ValueError, match="dimension"):
        index.upsert(spark.createDataFrame([(9, "x", [1.0])], "chunk_id long, text string, v array<double>"), vector="v")
    asked = spark.createDataFrame([(1, "apple pie", [1.0, 0.5])], "query_id long, question string, query_vector array<double>")
    assert index.count() == 3 and {r.chunk_id for r in index.bm25(asked).collect()} == {1, 2}
    index.upsert(spark.createDataFrame([(1, "pie", [0.0, 0.0])], "chunk_id long, text string, v array<double>"), vector="v").delete(docs.where("chunk_id = 2"))
    for compact in (False, True):
        now = index.compact() if compact else index
        assert now.count() == 2 and {r.chunk_id for r in now.bm25(asked).collect()} == {1}
        assert rows(now.dense(asked)) == [(1, 1, 0.0, 2), (1, 3, 1.5, 1)]
        want = R.bm25(spark.createDataFrame([(1, "pie"), (3, "")], "chunk_id long, text string"), asked, "chunk_id", "text", "query_id", "question")
        six = ["query_id", "chunk_id", "round(score, 6)"]
        assert rows(now.bm25(asked).selectExpr(*six)) == rows(want.withColumnRenamed("doc_id", "chunk_id").selectExpr(*six))
    other = Index.create(spark, f"file://{tmp_path}/k", 2)
    base = other.manifest()
    other.commits.publish(base, {}, base["info"] | {"analyzer": "other"})
    with pytest.raises(ValueError, match="compatible"):
        Index(spark, f"file://{tmp_path}/k").bm25(asked)


def test_vector_sink_merges(spark, tmp_path):
    make = lambda r: spark.createDataFrame(r, "id long, kb string, seq int, embedding array<double>")
    path = f"file://{tmp_path}/v"
    files.write_index(make([(1, "a", 1, [1.0]), (1, "a", 2, [2.0]), (2, "b", 1, [3.0])]), path, "id", "kb", 1)
    files.write_index(make([(1, "a", 3, [4.0]), (5, "a", 1, [5.0])]), path, "id", "kb", 1)
    assert rows(spark.read.parquet(path).select("kb", "id", "embedding")) == [("a", 1, [4.0]), ("a", 5, [5.0]), ("b", 2, [3.0])]


def test_payloads(spark):
    many = [{"name": f"n{i}", "type": "person"} for i in range(20)]
    payload = {"entities": [{"name": " Acme ", "type": "robot"}, {"name": ""}, *many], "relations": [{"source": "Acme", "predicate": "works with!", "target": "n0"}, {"source": "Acme", "target": "Acme"}, {"source": "Acme", "target": "n19"}, {"source": "n1", "target": "n2"}]}
    df = spark.createDataFrame([(1, json.dumps(payload)), (2, "no json")], "id long, p string").select("id", explorer.normalised(F.col("p")).alias("x")).orderBy("id")
    first, second = df.collect()
    assert [(e.name, e.kind) for e in first.x.entities] == [("Acme", "OTHER"), *((f"n{i}", "PERSON") for i in range(11))]
    assert [(r.source, r.predicate, r.target) for r in first.x.relations] == [("Acme", "WORKS_WITH", "n0"), ("n1", "RELATED_TO", "n2")] and second.x.entities == []


def test_extraction_asks_each_text_once_and_falls_back(spark):
    answers = {"good": json.dumps({"entities": [{"name": "X", "type": "EVENT"}]}), "empty": "{}"}
    model = lambda text: F.when(F.contains(text, F.lit("good")), F.lit(answers["good"])).when(F.contains(text, F.lit("empty")), F.lit(answers["empty"]))
    base = " and then Kilo met Lima in the old harbour of the town on a very long and windy day"
    chunks = spark.createDataFrame([(1, "good" + base), (2, "good" + base), (3, "empty" + base), (4, "lost" + base)], "chunk_id long, text string")
    got = {r.chunk_id: [e.name for e in r.entities] for r in explorer.extracted_by(chunks, model, "on").collect()}
    assert got == {1: ["X"], 2: ["X"], 3: ["Kilo", "Lima"], 4: ["Kilo", "Lima"]}


def test_explorer_lists(spark, graph_tables):
    entities, edges, mentions = graph_tables
    entities = entities.withColumn("kind", F.lit(""))
    page, total = explorer.listed_entities(entities, edges, sort="odd", limit=2)
    assert [(r.id, r.degree, r.kind) for r in page.collect()] == [(5, 2, "OTHER"), (1, 2, "OTHER")] and total.first().total == 5
    assert [r.id for r in explorer.listed_entities(entities, edges, sort="name", q="  ")[0].collect()] == [1, 2, 3, 4, 5]
    found, n = explorer.listed_relations(edges, entities, q="cedar")
    assert [(r.source, r.target) for r in found.collect()] == [(2, 3), (3, 4)] and n.first().total == 2
    assert [r.predicate for r in explorer.listed_relations(edges, entities, predicate="SEES", q="port")[0].collect()] == ["SEES"]
    nodes, inside = explorer.neighbourhood(edges, entities.select(F.col("id").alias("node"), "mentions"), spark.sql("select 1L as node"), 2, 3)
    assert rows(nodes) == [(1, 0, True), (2, 1, True), (5, 1, True)] and inside.count() == 2
    old, new = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert rows(explorer.merged_views(old, new, ["k"], "old")) == [(1, "x"), (2, "z")] and rows(explorer.merged_views(old, new, ["k"], "new")) == [(1, "y"), (2, "z")]


def test_ingest_end_to_end(spark, tmp_path):
    body = "# Head\n\n" + "The Acme Works met Borealis Fund in Cedar City with NASA and ESA on a bright day near the old river. " * 3
    made = spark.createDataFrame([("/in/a.md", body.encode()), ("/in/b.txt", b" "), ("/in/c.pdf", b"%PDF-1.4"), ("/in/d.txt", b"plain words only")], "path string, content binary").withColumn("length", F.length("content").cast("long"))
    index = Index.create(spark, f"file://{tmp_path}/i", 16)
    out = ingesting.ingest(made, "kb", "me", index, "on", T.hashed_vector(16))
    states = {r.filename: (r.status, r.error) for r in out.documents.collect()}
    assert states == {"a.md": ("ready", None), "b.txt": ("failed", "no text"), "c.pdf": ("failed", "no parser"), "d.txt": ("ready", None)}
    assert index.count() == out.chunks.count() and {"acme", "nasa"} <= {r.norm_name for r in out.entities.collect()}
    assert {r.status for r in ingesting.document_states(out.events).collect()} == {"ready", "failed"} and ingesting.document_states(out.events).where("broken > 0").count() == 0
    again = ingesting.rebuilt_graph(out.chunks, "kb", "on")
    assert rows(again[0]) == rows(out.entities) and ingesting.rebuilt_graph(out.chunks, "other")[0].count() == 0


def test_keyed_writes(spark):
    stored = spark.createDataFrame([(1, 1, "A"), (2, 1, "B")], "kb_id long, user_id long, name string")
    asked = spark.createDataFrame([(3, 1, " A "), (2, 1, "C"), (4, 1, " "), (5, 1, "N" * 121), (6, 1, "D"), (7, 1, "D"), (8, 2, "A")], "kb_id long, user_id long, name string")
    kept, refused = ingesting.saved_bases(stored, asked)
    assert rows(kept) == [(1, 1, "A"), (2, 1, "C"), (6, 1, "D"), (8, 2, "A")]
    assert {r.kb_id: r.reason for r in refused.collect()} == {3: "name is taken", 4: "empty name", 5: "long name", 7: "name is taken"}
    meta = ingesting.metadata(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), spark.createDataFrame([("b", "3", 1), ("b", "4", 2), ("c", "5", 1)], "key string, value string, at int"))
    assert rows(meta) == [("a", "1"), ("b", "4"), ("c", "5")]
    note = spark.createDataFrame([(6, 12, 1.0), (1, 12, 1.0), (1, 1, 50.0), (1, 1, 1.0)], "m int, f int, s double").select(ingesting.budget_note(F.col("m"), F.col("f"), F.col("s")))
    assert [r[0] for r in note.collect()] == ["main calls spent", "fast calls spent", "time spent", None]


def test_projections(spark):
    points = spark.createDataFrame([(1, 1, "", None, None, None, None)], "chunk_id long, doc_id long, filename string, text string, modality string, ordinal int, score double")
    assert rows(ingesting.stored_chunks(points)) == [(1, 1, "unknown", "", "text", 0, 0.0, "vector")]
    assets = spark.createDataFrame([("x", " ", "o" * 300), ("y", "cap", "z"), ("w", None, "")], "asset_id string, caption string, ocr_text string")
    assert rows(ingesting.media_rows(assets)) == [("w", "/media/w", None), ("x", "/media/x", "o" * 200), ("y", "/media/y", "cap")]
    calls = spark.createDataFrame([("a", 1, 2, 3, 1), ("a", 1, 1, None, 1)], "q string, prompt_tokens int, completion_tokens int, total_tokens int, calls int")
    assert rows(ingesting.usage(calls, "q")) == [("a", 2, 3, 3, 2)]
    hits = spark.createDataFrame([(1, 0.1234567), (2, 0.5)], "chunk_id long, score double")
    assert rows(ingesting.with_tokens(hits, spark.createDataFrame([(1, 9)], "chunk_id long, token_count int"))) == [(1, 0.12346, 9), (2, 0.5, 0)]
    chunks = spark.createDataFrame([(1, 5, [], [0.5])], "chunk_id long, doc_id long, dense array<double>, sparse array<double>")
    assert [(r.dense, r.sparse, r.payload.doc_id) for r in ingesting.points(chunks).collect()] == [(None, [0.5], 5)]


def test_layout(spark):
    heads = [
        ([["Name", "Year", "Sum"], ["a", "1", "2"]], ["Name", "Year", "Sum"], 1),
        ([["Group", "", ""], ["Name", "Year", "Sum"], ["a", "1", "2"]], ["Group Name", "Year", "Sum"], 1),
        ([["No", "Item"], ["(of all)", ""], ["1.", "x"], ["2.", "y"]], ["No (of all)", "Item"], 2),
    ]
    for table, header, n in heads:
        got = spark.createDataFrame([(table,)], "t array<array<string>>").select(T.split_header(F.col("t")).alias("x")).first().x
        assert got.header == header and len(got.body) == n, table
    caps = spark.createDataFrame([("Figure 3: the yearly flow of the river",), ("Figure 3: flow",), ("Some words that go on and on",), (None,)], "t string").select(T.standalone_caption(F.col("t")))
    assert [r[0] for r in caps.collect()] == [True, False, False, False]
    images = spark.createDataFrame([(64, 64, 6.0), (63, 500, 9.0), (64, 1281, 9.0), (100, 100, 5.9), (100, 100, None)], "w int, h int, s double").select(T.meaningful_image(F.col("w"), F.col("h"), F.col("s")))
    assert [r[0] for r in images.collect()] == [True, False, False, False, False]
    near = explore.nearest_caption(
        spark.createDataFrame([(1, 1, 100.0, 200.0), (2, 2, 0.0, 10.0)], "image int, page int, y0 double, y1 double"),
        spark.createDataFrame([(1, 205.0, 210.0, "plain text"), (1, 300.0, 310.0, "Figure 1 shows it"), (1, 325.0, 330.0, "Figure 2"), (2, 140.0, 150.0, "far")], "page int, y0 double, y1 double, text string"),
    )
    assert rows(near) == [(1, "Figure 1 shows it")]


def test_images_and_furniture(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"x" * 9
    gif, bmp = b"GIF89a" + (30).to_bytes(2, "little") + (20).to_bytes(2, "little") + b"x" * 20, b"BM" + b"\0" * 16 + (7).to_bytes(4, "little") + (9).to_bytes(4, "little") + b"x" * 9
    made = spark.createDataFrame([("/a/My_red-boat.png", png), ("/a/b.gif", gif), ("/a/c.bmp", bmp), ("/a/d.jpg", b"\xff\xd8\xff"), ("/a/e.png", b"\x89PNG")], "path string, content binary")
    got = {r.path: (r.text, r.modality, r.error) for r in files.blocks(made).collect()}
    assert got["/a/My_red-boat.png"] == ("Image: My_red-boat.png\nTitle: my red boat\nSize: 640 x 480", "caption", None)
    assert got["/a/b.gif"][0].endswith("Size: 30 x 20") and got["/a/c.bmp"][0].endswith("Size: 7 x 9")
    assert got["/a/d.jpg"][0] == "Image: d.jpg\nTitle: d" and "Size" not in got["/a/e.png"][0]
    read = files.image_blocks(made.where("path like '%gif'"), ocr=F.lit(" three real words ")).first()
    assert read.modality == "ocr" and "three real words" in read.text
    lines = spark.createDataFrame([(1, "Report 7", 10.0, 20.0), (1, "12", 980.0, 990.0), (1, "Report 7", 500.0, 510.0), (1, "Other", 10.0, 20.0), (2, "Report 7", 10.0, 20.0)], "doc int, text string, y0 double, y1 double").withColumn("height", F.lit(1000.0))
    heads = spark.createDataFrame([(1, "Report #", 3)], "doc int, line string, pages int")
    assert rows(explore.without_furniture(lines, heads, "doc").select("doc", "text", "y0")) == [(1, "Other", 10.0), (1, "Report 7", 500.0), (2, "Report 7", 10.0)]
    mine = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, user_id string")
    assert rows(explore.owned(mine, "a")) == [(1, "a")]
    named = explore.with_name(spark.createDataFrame([(1, 5), (2, 6)], "id int, doc_id int"), spark.createDataFrame([(5, "x.pdf")], "doc_id int, filename string"), "doc_id", "doc_id", "filename", "unknown")
    assert rows(named) == [(1, 5, "x.pdf"), (2, 6, "unknown")]


def test_hits_of_seeds_and_hubs_are_computed_once(spark):
    entities = spark.createDataFrame([(1, "copper ring", "Copper ring", "", 3), (2, "iron ring", "Iron ring", "", 40)], "id long, norm_name string, name string, description string, mentions long")
    questions = spark.createDataFrame([(1, "which cooper made it"), (2, "no such thing")], "query_id long, question string")
    edges = spark.createDataFrame([(1, "P", 2, 5, [7])], "source long, predicate string, target long, weight long, chunks array<long>")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    seeds = evidence.found_seeds(questions, entities)
    assert "levenshtein" not in plan(seeds) and [(r.question_id, r.id) for r in seeds.collect()] == [(1, 1)]
    found = evidence.hops(edges, entities, spark.sql("select 1L as query_id, 1L as node"))
    assert "percentile" not in plan(found) and found.count() == 1
