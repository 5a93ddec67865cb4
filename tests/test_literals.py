"""Small literal cases for what the driver's tables don't hold."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import answers as A
from siltstone.operators import chat, chunking, explore, graph
from siltstone.operators import retrieval as R
from siltstone.sources import files as S
from siltstone.streaming import ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, "a\r\nb c-\nd \n\n\n\n e ", T.clean) == "a\nb cd\n\ne"
    assert one(spark, "The Straße, Inc.", T.normal_name) == "straße inc"
    assert one(spark, "x" * 400, T.snippet) == "x" * 320 + "..."
    assert one(spark, "<think>no</think>Yes<think>cut", T.without_reasoning) == "Yes"
    assert [one(spark, v, T.tri_state) for v in ("Yes", "false", "maybe", None)] == [True, False, None, None]
    assert one(spark, "Error 429 not found", T.retry_class) == "fatal" and one(spark, "429", T.retry_class) == "retryable"
    assert one(spark, "page text\n- 12 -\n13", T.without_page_number) == "page text"
    assert one(spark, "What links Article 368 and the Seventh Schedule, schedule?", T.question_terms) == ["368", "Schedule", "Article", "Seventh", "links"]
    assert one(spark, "../x", T.escapes) and not one(spark, "a..b/c", T.escapes)
    assert one(spark, '```json\n{"a": 1,}\n```', lambda x: T.json_object(x, "a int")["a"]) == 1
    table = one(spark, [["a", ""], ["1", "2|3"], ["", ""]], T.markdown_table, "array<array<string>>")
    assert table == "| a | Column 2 |\n| --- | --- |\n| 1 | 2\\|3 |"


def test_chunking(spark):
    long_word, many = "w" * 25, " ".join(["Aa bb."] * 6)
    pieces = one(spark, f"{many}\n\nShort one.\n\n{long_word}", lambda x: chunking.split_long(x, 20))
    assert pieces == ["Aa bb. Aa bb. Aa bb.", "Aa bb. Aa bb. Aa bb.", "Short one.", "w" * 20, "w" * 5]
    assert one(spark, ["one two three", "four"], lambda x: chunking.with_overlap(x, 7), "array<string>") == ["one two three", "three four"]
    head = "| a | b |\n| --- | --- |"
    rows = "\n".join(f"| {i} | {'x' * 150} |" for i in range(5))
    windows = one(spark, f"{head}\n{rows}", lambda x: chunking.table_windows(x, F.lit("S (table)"), 400))
    assert len(windows) == 3 and all(w.startswith(f"S (table)\n\n{head}\n") for w in windows)
    assert one(spark, head, lambda x: chunking.table_windows(x, F.lit(""), 400)) == []
    blocks = spark.createDataFrame(
        [(1, 1, "a", 1, None, "text"), (1, 2, "b", 1, None, "text"), (1, 3, "t", 1, None, "caption"), (1, 4, "c", 2, None, "text"), (1, 5, " ", 2, None, "text")],
        "doc_id long, seq int, text string, page_no int, section string, modality string",
    )
    got = [(r.ordinal, r.chunk_text, r.modality) for r in chunking.merged_blocks(blocks).orderBy("ordinal").collect()]
    assert got == [(1, "a\n\nb", "text"), (2, "t", "caption"), (3, "c", "text")]


def test_answers(spark):
    long = "This claim is long enough to be counted as one that needs a source"
    ground = lambda text, n=1: one(spark, text, lambda x: A.grounding(x, F.lit(n)))
    assert ground(f"{long} [1]. {long}.") == 0.5
    assert ground(f"{long}:\n\n- item one\n- item two [2]") == 1.0
    assert ground(f"The provided sources do not say anything about this matter at all. # {long}"[:66]) is None
    assert ground("") is None and ground(long, 0) == 0.0
    assert one(spark, "See [3] and [9], then [1] [3].", lambda x: A.renumbered(x, F.lit(5))) == "See [1] and, then [2] [1]."
    routes = {"hi!": "DIRECT", "what is a widget": "VECTOR", "Compare Alpha Corp and Beta Corp": "MULTIHOP", "How is Alice connected with Bob Smith": "GRAPH", "Rivers and lakes": "HYBRID"}
    assert {q: one(spark, q, A.route) for q in routes} == routes
    assert one(spark, "How is Alice connected with Bob Smith", lambda x: A.route(x, graph_on=False)) == "HYBRID"
    needs = lambda q: one(spark, q, lambda x: A.needs_rewrite(x, F.lit(True)))
    assert needs("why") and needs("does it apply in winter") and not needs("the rivers of northern Norway")


def test_verdicts(spark):
    rows = [(1, i, s) for i, s in enumerate([0.30, 0.32, 0.50, 0.50])]
    v = A.with_previous(spark.createDataFrame(rows, "q int, pass int, score double"), "q", "pass")
    out = v.withColumn("stop", A.stop_reason(F.col("score"), F.col("previous"), F.lit(None).cast("boolean"), F.lit(""), F.lit(False))).orderBy("pass").collect()
    assert [r.stop for r in out] == [None, "stalled", None, "stalled"] and out[3].best_pass == 3


def test_retrieval(spark):
    hits = spark.createDataFrame([("a", 0.9, 1), ("b", 0.4, 2), ("b", 0.7, 3), ("c", 0.5, 4), ("a", 0.2, 5), ("d", 0.8, 6), ("d", 0.8, 7)], "chunk_id string, score double, seq int")
    assert {(r.chunk_id, r.score, r.seq) for r in R.merged(hits, "chunk_id").collect()} == {("a", 0.9, 1), ("b", 0.7, 3), ("c", 0.5, 4), ("d", 0.8, 6)}
    pool = spark.createDataFrame([(1, i, 1 / (1 + i % 5), (i - 25) / 2) for i in range(50)], "query_id int, seq int, score double, logit double")
    first = lambda w: R.blended(pool, weight=w).orderBy("rank").first().seq
    assert first(1.0) == 49 and first(0.0) % 5 == 0
    capped = R.blended(pool.unionByName(pool.withColumn("seq", F.col("seq") + 50)))
    assert capped.count() == 80


def test_seeds(spark):
    rows = [(1, "How do the Constitution and the Seventh Schedule meet?", i, n, m) for i, (n, m) in enumerate([("constitution", 82), ("seventh schedule", 8), ("schedule seven", 3), ("article 5", 2), ("this constitution", 1)])]
    got = graph.seeds(spark.createDataFrame(rows, "question_id int, question string, seq int, norm_name string, mentions int"), "question").collect()
    assert {r.norm_name for r in got} == {"seventh schedule", "schedule seven"}


def test_chat_and_upkeep(spark):
    rows = [("s", i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(["Q1", "A1", "Q2", "A2", "Q3", "A3"])]
    messages = spark.createDataFrame(rows, "session string, at int, role string, content string")
    left = lambda at: [r.content for r in chat.after_deletion(messages, spark.createDataFrame([("s", at)], "session string, at int"), "session", "at").orderBy("at").collect()]
    assert left(2) == ["Q1", "A1", "Q3", "A3"] and left(1) == ["Q1", "Q2", "A2", "Q3", "A3"] and len(left(99)) == 6
    assert chat.titles(messages, "session", "at", "content").first().title == "Q1"
    pages = spark.createDataFrame([(1, i, f"Head {i}\nbody {'x' * i}\n{i}") for i in range(5)], "doc int, page int, text string")
    assert [r.line for r in explore.repeated_lines(pages, "doc", "page", "text").collect()] == ["Head #"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n# One\nbody\n## Two\nmore\n# Three")
    (tmp_path / "b.txt").write_bytes("café\r\n".encode("cp1252"))
    (tmp_path / "c.json").write_text(json.dumps([{"name": "x", "v": [1, {}]}, {"id": 7}, None]))
    (tmp_path / "d.json").write_text("{broken")
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p></w:body></w:document>')
    rows = S.blocks(S.read(spark, str(tmp_path))).orderBy("path", "seq").collect()
    by = {}
    for r in rows:
        by.setdefault(r.path[-4:].lstrip("/"), []).append((r.section, r.text))
    assert by["a.md"] == [(None, "intro"), ("One", "One"), ("One", "body"), ("One > Two", "Two"), ("One > Two", "more"), ("Three", "Three")]
    assert by[".txt"] == [(None, "café")]
    texts = [(r.section, r.text) for r in rows if r.path.endswith("c.json")]
    assert texts == [("c[0] (x)", "[0].name = x\n[0].v[0] = 1\n[0].v[1] = {}"), ("c[1] (7)", "[1].id = 7"), ("c[2] (record 2)", "[2] = null")]
    assert [r.error is not None for r in rows if r.path.endswith("d.json")] == [True]
    assert by["docx"] == [("Top", "Top"), ("Top", "Text")]


def test_zip_guards(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "x")
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ok.txt", "fine")
        z.writestr("../out.txt", "no")
        z.writestr("run.exe", "no")
        z.writestr("bomb.txt", "0" * 2_000_000)
        z.writestr("in.zip", inner.getvalue())
    (tmp_path / "b.zip").write_bytes(b"PK??")
    got = {(r.path[-5:], r.name): r.reason for r in S.zip_entries(S.read(spark, str(tmp_path))).collect()}
    assert got == {("a.zip", "ok.txt"): None, ("a.zip", "../out.txt"): "path", ("a.zip", "run.exe"): "extension", ("a.zip", "bomb.txt"): "ratio", ("a.zip", "in.zip/deep.txt"): None, ("b.zip", None): "broken"}


def test_one_archive_is_unpacked_by_several_tasks(spark, tmp_path):
    inner, link = io.BytesIO(), zipfile.ZipInfo("link.txt")
    link.external_attr = 0o120777 << 16
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("in1.txt", "1" * 900)
        z.writestr("in2.txt", "2" * 900)
        z.writestr("deepest.zip", b"PK")
    (tmp_path / "new folder").mkdir()
    with zipfile.ZipFile(tmp_path / "new folder" / "a #1.zip", "w") as z:
        for i in range(30):
            z.writestr(f"f{i}.txt", f"{i} " * 300)
        z.writestr("in.zip", inner.getvalue())
        z.writestr("bad.zip", b"no archive")
        z.writestr(link, "f0.txt")
        z.writestr("last.txt", "end")
    with zipfile.ZipFile(tmp_path / "new folder" / "empty.zip", "w"):
        pass
    files = S.read(spark, str(tmp_path / "new folder"))
    got = S.zip_entries(files, deepest=2, range_bytes=1000).withColumn("task", F.spark_partition_id()).collect()
    by = {r.name: r for r in got}
    assert len(by) == len(got) == 30 + 3 + 3 and len({r.task for r in got}) > 1
    assert all(bytes(by[f"f{i}.txt"].content) == (f"{i} " * 300).encode() for i in range(30))
    assert [(by[f"in.zip/in{i}.txt"].depth, bytes(by[f"in.zip/in{i}.txt"].content)) for i in (1, 2)] == [(2, b"1" * 900), (2, b"2" * 900)]
    assert {n: r.reason for n, r in by.items() if r.reason} == {"in.zip/deepest.zip": "depth", "bad.zip": "broken", "link.txt": "symlink"}
    few = S.zip_entries(files, entries=5, range_bytes=1000).collect()
    assert sum(r.reason is None for r in few) == 5 and {r.reason for r in few} == {None, "budget", "symlink"}
    small = S.zip_entries(files, most=1500, range_bytes=1000).collect()
    assert {r.name for r in small if r.reason is None} == {"f0.txt", "f1.txt", "last.txt"}


def test_streams(spark, tmp_path):
    rows = [(u, f"2024-01-01 00:00:{s:02d}", u * 100 + s) for u in (1, 2) for s in range(0, 30, 5)]
    events = spark.createDataFrame(rows, "user_id long, ts string, event_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = ingest.limited(events, "user_id", "ts", "event_id", 6.0, 2.0)
    want = {(1, 100): True, (1, 105): True, (1, 110): True, (1, 115): False, (1, 120): True, (1, 125): False}
    assert {(r.key, r.event): r.allowed for r in batch.where("key = 1").collect()} == want
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timeouts keep an availableNow run going
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.where("event_id % 100 < 15").coalesce(1).write.parquet(source)
    schema = "user_id long, ts timestamp, event_id long"

    def drain():
        q = ingest.limited_stream(ingest.file_stream(spark, source, schema), "user_id", "ts", "event_id", 6.0, 2.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    drain()
    events.where("event_id % 100 >= 15").coalesce(1).write.mode("append").parquet(source)
    drain()  # a restart goes on with the state it left: nothing is lost, nothing comes twice
    got = spark.read.parquet(out)
    assert got.count() == 12 and {(r.key, r.event): r.allowed for r in got.where("key = 1").collect()} == want
    sink = ingest.upserting(str(tmp_path / "table"), "user_id", ["event_id"])
    for epoch, part in enumerate((events.where("event_id < 210"), events.where("event_id >= 210"), events.where("event_id >= 210"))):
        sink(part, min(epoch, 1))
    assert {(r.user_id, r.event_id) for r in ingest.current(spark, str(tmp_path / "table"), "user_id").collect()} == {(1, 125), (2, 225)}
