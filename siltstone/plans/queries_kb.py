"""Registered queries of the stored index, routed retrieval, the explorer and the ingest, each with its DuckDB twin where SQL
has one. Parts stand in as entities, parts bought together as relations, orders as chunks that mention their parts."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import answers as A
from siltstone.operators import evidence, explore, explorer, graph
from siltstone.operators import retrieval as R
from siltstone.plans import ingesting
from siltstone.plans.lineage import cut, folder
from siltstone.plans.queries import BM25_SQL, EDGES_SQL, KHOP_SQL, edges, parts, query, questions, t
from siltstone.sources.graph_store import GraphStore
from siltstone.sources.index import LAYOUT, Index
from siltstone.streaming import jobs

# ---- the stored index -----------------------------------------------------------------------------------------------

def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: an index of other files is not used again."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    found = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top)
    return tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in found))


def corpus_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of documents with their vectors (by equal number), stored under the fingerprint of the tables' files: whatever
    session comes next opens it again."""
    names = [f"{sf_dir}/{x}.parquet" for x in ("documents", "embeddings")]
    key = hashlib.sha256(repr([LAYOUT, *[fingerprint(spark, n) for n in names]]).encode()).hexdigest()[:24]
    index = Index(spark, f"{folder(spark)}/index-{key}")
    now = index.commits.manifest()
    if not now["info"].get("complete"):
        docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
        vectors = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
        if not now["version"]:
            Index.create(spark, index.path, vectors.select(F.max(F.size("embedding"))).first()[0] or 0)
        # the write has a token: what a killed session has done isn't done again
        index.upsert(docs, token="texts and vectors", vectors=vectors)
        if index.meta()["gens"] > 1:  # beside writes of another kind
            index.compact()
        done = index.commits.manifest()
        index.commits.publish(done, {}, done["info"] | {"complete": True})
    return index


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM lex WHERE rank <= 12")
def bm25_batch(spark, sf_dir):
    """The batch of questions by stored postings."""
    return corpus_index(spark, sf_dir).top(questions(spark, sf_dir)).select("query_id", F.col("chunk_id").alias("doc_id"), "score", "rank")


@query(
    f"""WITH {BM25_SQL} SELECT l.doc_id, l.rank::INTEGER AS rank, CASE WHEN length(f) <= 320 THEN f ELSE rtrim(substr(f, 1, 320)) || '...' END AS snippet
FROM lex l JOIN (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents) d ON d.doc_id = l.doc_id WHERE query_id = 0 AND rank <= 12"""
)
def bm25_topk(spark, sf_dir):
    """One question by stored postings: its twelve best documents with snippets."""
    best = corpus_index(spark, sf_dir).top(questions(spark, sf_dir).where("query_id = 0")).select(F.col("chunk_id").alias("doc_id"), "rank")
    return t(spark, sf_dir, "documents").join(F.broadcast(best), "doc_id").select("doc_id", "rank", T.snippet(F.col("text")).alias("snippet"))  # twelve rows


@query(
    """SELECT count(*) AS chunks, count(*) FILTER (WHERE doc_id % 3 <> 0) AS old, count(*) FILTER (WHERE doc_id % 3 = 0) AS renewed,
  sum(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) END)::BIGINT AS words FROM documents WHERE doc_id % 5 <> 0"""
)
def index_writes(spark, sf_dir):
    """An index after an upsert of every third document and a deletion of every fifth."""
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    index = Index.create(spark, f"{folder(spark)}/index-{uuid.uuid4().hex}", 0)
    index.upsert(docs).upsert(docs.where("chunk_id % 3 = 0").withColumn("text", F.lit("new text"))).delete(docs.where("chunk_id % 5 = 0"))
    live = index.lengths()
    return live.agg(F.count(F.lit(1)).alias("chunks"), F.count(F.when(F.col("gen") == 2, 1)).alias("old"), F.count(F.when(F.col("gen") == 3, 1)).alias("renewed"), F.sum("dl").cast("long").alias("words"))


HYBRID_SQL = f"""{BM25_SQL},
v AS (SELECT doc_id, embedding::DOUBLE[] AS e FROM embeddings JOIN documents ON doc_id = vec_id),
den AS (SELECT item_id AS query_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], v.e), 6) DESC, doc_id) AS rank FROM benchmark JOIN embeddings q ON q.vec_id = item_id, v),
u AS (SELECT query_id, doc_id, 1.0::DOUBLE / (1 + rank) AS p FROM den WHERE rank <= 24 UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (1 + rank) FROM lex WHERE rank <= 24),
f AS (SELECT query_id, doc_id, round(sum(p), 9) AS score FROM u GROUP BY 1, 2)"""


def with_vectors(spark, sf_dir) -> DataFrame:
    """Questions with the vector of their number."""
    asked = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return questions(spark, sf_dir).join(asked, "query_id")


@query(f"WITH {HYBRID_SQL} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 12")
def rrf_hybrid(spark, sf_dir):
    """BM25 and dense ranks over the same stored chunks, fused."""
    found = corpus_index(spark, sf_dir).hybrid(with_vectors(spark, sf_dir))
    return found.select("query_id", F.col("chunk_id").alias("doc_id"), "score", "rank")


# ---- the stored graph -----------------------------------------------------------------------------------------------


def parts_store(spark, sf_dir) -> GraphStore:
    """Orders as documents that mention parts: written in two commits, the second one again in place of itself, then every fifth
    order deleted. Stored under the fingerprint of the table; each commit has a token."""
    key = hashlib.sha256(repr(fingerprint(spark, f"{sf_dir}/lineitem.parquet")).encode()).hexdigest()[:24]
    store = GraphStore(spark, f"{folder(spark)}/graph-{key}", "long")
    if not store.commits.versions():
        GraphStore.create(spark, store.path, "long", buckets=32)
    if "deleted" not in store.commits.manifest()["tokens"]:
        lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
        said = lines.select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("doc_id"), F.lit(1).cast("long").alias("seq"), F.col("l_partkey").cast("string").alias("name"), F.lit("PART").alias("kind"), F.lit("").alias("description"), "n")
        left, right = lines.select("l_orderkey", F.col("l_partkey").alias("source")), lines.select("l_orderkey", F.col("l_partkey").alias("target"))
        pairs = left.join(right, "l_orderkey").where("source < target").select("source", F.lit("BOUGHT_WITH").alias("predicate"), "target", F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("n"))
        first, second = F.col("doc_id") % 4 != 0, F.col("doc_id") % 4 == 0
        store.upsert(said.where(first), pairs.where(first), "first").upsert(said.where(second), pairs.where(second), "second")
        store.upsert(said.where(second), pairs.where(second), "second again", replace=True)
        store.delete(said.where("doc_id % 5 = 0").select("doc_id"), "deleted")
    return store


STORE_SQL = KHOP_SQL.replace("FROM lineitem", "FROM left_lines").replace("WITH ", "WITH left_lines AS (SELECT * FROM lineitem WHERE l_orderkey % 5 <> 0), ", 1)


@query(f"{STORE_SQL} SELECT source, count(*) AS n, sum(weight)::BIGINT AS weight, sum(target)::BIGINT AS targets FROM hop GROUP BY 1")
def stored_khop(spark, sf_dir):
    """Two hops in the stored graph after upserts, a replacement and a deletion; each hop reads its frontier's buckets."""
    found = parts_store(spark, sf_dir).khop(spark.range(0, 6).select(F.col("id").alias("node")), 2, None)
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.sum("target").alias("targets"))


@query(f"WITH {EDGES_SQL.replace('FROM lineitem', 'FROM left_lines')} SELECT node, mentions, coalesce(d, 0)::BIGINT AS degree FROM parts LEFT JOIN (SELECT node, count(*) AS d FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1) USING (node)".replace("WITH ", "WITH left_lines AS (SELECT * FROM lineitem WHERE l_orderkey % 5 <> 0), ", 1))
def stored_entities(spark, sf_dir):
    """Mentions and degree of every entity that is left in the stored graph."""
    store = parts_store(spark, sf_dir)
    degree = store.adjacent().groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return store.entities().join(degree, "node", "left").select("node", "mentions", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


# ---- the job stream -------------------------------------------------------------------------------------------------


@query(
    """WITH j AS (SELECT user_id, sum((event_type <> 'error' AND value >= 20)::INTEGER)::BIGINT AS done, sum((value < 20)::INTEGER)::BIGINT AS failed FROM events GROUP BY 1)
SELECT user_id::VARCHAR AS job, done + failed AS processed, failed, 60::BIGINT AS total,
  CASE WHEN done + failed = 0 THEN 'queued' WHEN done + failed < 60 THEN 'running' WHEN failed = 0 THEN 'completed' WHEN done = 0 THEN 'failed' ELSE 'completed_with_errors' END AS state FROM j"""
)
def job_stream(spark, sf_dir):
    """The events replayed as a stream of jobs' file outcomes; the newest change of each job."""
    out, where = f"{folder(spark)}/jobs-{uuid.uuid4().hex}", spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(t(spark, sf_dir, "events").schema)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        events = reader.parquet(f"{sf_dir}/events.parquet")
    else:  # a stream reads folders; the table is one file of its folder
        events = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    outcome = F.when(F.col("value") < 20, "failed").when((F.col("event_type") != "error") & (F.col("value") >= 20), "done").otherwise("beat")
    rows = events.select(F.col("user_id").cast("string").alias("job"), F.col("ts").cast("timestamp").alias("at"), outcome.alias("outcome"), F.lit(60).alias("total"))
    jobs.run(rows, f"{out}/changes", f"{out}/checkpoint")
    return jobs.states(spark, f"{out}/changes").select("job", "processed", "failed", "total", "state")


# ---- routed retrieval -----------------------------------------------------------------------------------------------


def parts_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, relations, mentions, chunks); relations carry the orders that hold both parts."""
    lines = t(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    mentions = lines.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("chunk_id"), "n")
    counted = parts(spark, sf_dir).withColumnRenamed("node", "id")
    named = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_name").alias("norm_name"), F.col("p_brand").alias("kind"), F.col("p_type").alias("description"))
    entities = named.join(counted, "id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    chunks = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("filename"), (F.col("o_orderkey") % 7).cast("int").alias("page_no"))
    return entities, edges(spark, sf_dir), mentions, chunks


PARTS_SQL = f"""{EDGES_SQL}, ents AS (SELECT p_partkey AS id, p_name AS name, p_brand AS kind, p_type AS description, coalesce(mentions, 0) AS mentions FROM part LEFT JOIN parts ON node = p_partkey),
ment AS (SELECT l_partkey AS id, l_orderkey AS chunk_id, count(*) AS n FROM lineitem GROUP BY 1, 2),
chk AS (SELECT o_orderkey AS chunk_id, o_custkey AS doc_id, o_orderpriority AS filename, (o_orderkey % 7)::INTEGER AS page_no FROM orders),
deg AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1)"""


@query()
def routed_retrieval(spark, sf_dir):
    """Every benchmark question by its route, over the stored index and the graph of names found in the documents."""
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")
    found = cut(graph.extracted(docs, "chunk_id", "text"))
    known = graph.upsert_entities(found).select(F.xxhash64("norm_name").alias("id"), "norm_name", "name", "description", "mentions")
    pairs = graph.co_mentions(found).groupBy("source", "predicate", "target").agg(F.count(F.lit(1)).alias("weight"), F.slice(F.array_sort(F.collect_set("doc_id")), 1, 24).alias("chunks"))
    rel = cut(pairs.select(F.xxhash64("source").alias("source"), "predicate", F.xxhash64("target").alias("target"), "weight", "chunks"))
    mentions = found.select(F.xxhash64("norm_name").alias("id"), F.col("doc_id").alias("chunk_id")).distinct()
    index = corpus_index(spark, sf_dir)

    def search(asked: DataFrame, k: int) -> DataFrame:
        return index.top(asked, k)

    corpus = evidence.Corpus(search, docs, cut(known), rel, cut(mentions))
    asked = questions(spark, sf_dir).withColumn("route", A.route(F.col("question")))
    return evidence.retrieved(corpus, asked)


@query(
    f"""WITH {PARTS_SQL}, cut AS (SELECT greatest(10.0, quantile_cont(mentions, 0.99)) AS c FROM ents), hub AS (SELECT id FROM ents, cut WHERE mentions >= c),
s AS (SELECT id % 3 AS query_id, id AS node FROM ents WHERE id BETWEEN 1 AND 6), ways AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges),
front AS (SELECT * FROM s UNION SELECT query_id, b FROM ways JOIN s ON a = node WHERE (query_id, b) NOT IN (SELECT (query_id, node) FROM s) AND b NOT IN (SELECT id FROM hub)),
hop AS (SELECT DISTINCT query_id, source, predicate, target, weight FROM front JOIN edges ON node = source OR node = target WHERE NOT (source IN (SELECT id FROM hub) AND target IN (SELECT id FROM hub)))
SELECT query_id, source, target, weight, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, source, target) AS rank FROM hop) WHERE rank <= 80"""
)
def khop_batch(spark, sf_dir):
    """Three questions of two seed parts each: their edges within two hops, 80 at most."""
    entities, rel, _, _ = parts_graph(spark, sf_dir)
    start = entities.where("id between 1 and 6").select((F.col("id") % 3).alias("query_id"), F.col("id").alias("node"))
    return evidence.hops(cut(rel), cut(entities.select("id", "mentions")), start).select("query_id", "source", "target", "weight", "rank")


@query(
    f"""WITH {PARTS_SQL}, s AS (SELECT id % 3 AS query_id, id AS node FROM ents WHERE id BETWEEN 1 AND 6),
ways AS (SELECT source AS a, target AS b, weight FROM edges UNION ALL SELECT target, source, weight FROM edges),
near AS (SELECT query_id, b AS node, sum(weight) AS strength FROM ways JOIN s ON a = node WHERE (query_id, b) NOT IN (SELECT (query_id, node) FROM s) GROUP BY 1, 2),
hit AS (SELECT query_id, chunk_id, max(strength) AS strength FROM near JOIN ment ON id = node GROUP BY 1, 2)
SELECT query_id, chunk_id, seq::INTEGER AS seq FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, chunk_id) AS seq FROM hit) WHERE seq <= 10"""
)
def widened_chunks(spark, sf_dir):
    """Orders that hold parts bought with the seeds."""
    entities, rel, mentions, _ = parts_graph(spark, sf_dir)
    start = entities.where("id between 1 and 6").select((F.col("id") % 3).alias("query_id"), F.col("id").alias("node"))
    return evidence.widened(rel, mentions, start)


# ---- the explorer ---------------------------------------------------------------------------------------------------


@query(f"WITH {PARTS_SQL} SELECT id, name, kind, description, mentions, coalesce(degree, 0) AS degree FROM ents LEFT JOIN deg ON node = id WHERE contains(lower(name), 'ring') ORDER BY coalesce(degree, 0) DESC, mentions DESC, name, id LIMIT 50")
def entity_list(spark, sf_dir):
    entities, rel, _, _ = parts_graph(spark, sf_dir)
    return explorer.listed_entities(entities, rel, "Ring")[0].select("id", "name", "kind", "description", "mentions", "degree")


@query(
    f"""WITH {PARTS_SQL}, r AS (SELECT e.*, a.name AS source_name, b.name AS target_name FROM edges e JOIN ents a ON a.id = source JOIN ents b ON b.id = target)
SELECT source, target, weight, source_name, target_name FROM r WHERE contains(lower(source_name), 'red') OR contains(lower(target_name), 'red') OR contains(lower(predicate), 'red')
ORDER BY weight DESC, source_name, target_name, source, target LIMIT 50"""
)
def relation_list(spark, sf_dir):
    entities, rel, _, _ = parts_graph(spark, sf_dir)
    return explorer.listed_relations(rel, entities, "Red")[0].select("source", "target", "weight", "source_name", "target_name")


@query(
    f"""WITH {PARTS_SQL}, o AS (SELECT source AS id, least(count(*), 200) AS outgoing FROM edges GROUP BY 1), i AS (SELECT target AS id, least(count(*), 200) AS incoming FROM edges GROUP BY 1),
m AS (SELECT id, least(count(*), 50) AS mentioned_in FROM ment JOIN chk USING (chunk_id) GROUP BY 1)
SELECT id, name, mentions, coalesce(outgoing, 0)::INTEGER AS outgoing, coalesce(incoming, 0)::INTEGER AS incoming, coalesce(mentioned_in, 0)::INTEGER AS mentioned_in
FROM ents LEFT JOIN o USING (id) LEFT JOIN i USING (id) LEFT JOIN m USING (id) WHERE id BETWEEN 10 AND 19"""
)
def entity_details(spark, sf_dir):
    """Ten entities with their relations and mentions, here as counts."""
    entities, rel, mentions, chunks = parts_graph(spark, sf_dir)
    found = explorer.details(entities.where("id between 10 and 19"), entities, rel, mentions, chunks)
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).alias(c)
    return found.select("id", "name", "mentions", n("outgoing"), n("incoming"), n("mentioned_in"))


@query(f"WITH {PARTS_SQL} SELECT id, rank::INTEGER AS rank, chunk_id, filename, page_no, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, filename, page_no, chunk_id) AS rank FROM ment JOIN chk USING (chunk_id)) WHERE rank <= 50")
def mention_lists(spark, sf_dir):
    _, _, mentions, chunks = parts_graph(spark, sf_dir)
    return explorer.mention_list(mentions, chunks)


@query(f"WITH {PARTS_SQL} SELECT (SELECT count(*) FROM ents) AS entities, (SELECT count(*) FROM edges) AS relations, (SELECT count(*) FROM chk) AS chunks")
def graph_stats(spark, sf_dir):
    entities, rel, _, chunks = parts_graph(spark, sf_dir)
    return explorer.stats(entities, rel, chunks)


@query(
    f"""WITH {PARTS_SQL}, ways AS (SELECT source AS a, target AS b, weight FROM edges UNION ALL SELECT target, source, weight FROM edges),
d1 AS (SELECT b AS node, row_number() OVER (ORDER BY sum(weight) DESC, any_value(mentions) DESC, b) AS r FROM ways JOIN ents ON id = b WHERE a = 1 AND b <> 1 GROUP BY b),
k1 AS (SELECT node FROM d1 WHERE r <= 39),
d2 AS (SELECT b AS node, row_number() OVER (ORDER BY sum(weight) DESC, any_value(mentions) DESC, b) AS r FROM ways JOIN ents ON id = b WHERE a IN (SELECT node FROM k1) AND b <> 1 AND b NOT IN (SELECT node FROM k1) GROUP BY b),
k2 AS (SELECT node FROM d2 WHERE r <= 39 - (SELECT count(*) FROM k1))
SELECT node, depth, (SELECT count(*) FROM d1) > 39 OR (SELECT count(*) FROM d2) > 39 - (SELECT count(*) FROM k1) AS truncated FROM (SELECT 1::BIGINT AS node, 0 AS depth UNION ALL SELECT node, 1 FROM k1 UNION ALL SELECT node, 2 FROM k2)"""
)
def bfs_view(spark, sf_dir):
    """The neighbourhood of one part within 40 nodes, strongest first."""
    entities, rel, _, _ = parts_graph(spark, sf_dir)
    nodes, _ = explorer.neighbourhood(cut(rel), entities.select(F.col("id").alias("node"), "mentions"), spark.sql("select 1L as node"), 2, 40)
    return nodes


@query("SELECT p_partkey AS node, CASE WHEN p_partkey < 60 THEN 'old' ELSE 'new' END AS view FROM part WHERE p_partkey < 100")
def merged_nodes(spark, sf_dir):
    """Two overlapping views of the graph as one: of nodes the ones shown before stay."""
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    old, new = p.where("node < 60").withColumn("view", F.lit("old")), p.where("node between 30 and 99").withColumn("view", F.lit("new"))
    return explorer.merged_views(old, new, ["node"], "old")


# ---- ingest, chats, states ------------------------------------------------------------------------------------------


@query("SELECT conv_id AS session_id, count(*)::BIGINT AS message_count FROM conversations GROUP BY 1")
def saved_messages(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), "role", "text")
    sessions = rows.select("session_id").distinct().withColumn("message_count", F.lit(0).cast("long"))
    return ingesting.saved_messages(sessions, rows)[1]


@query("SELECT conv_id AS message_id, unnest(range(1, count(*) + 1))::INTEGER AS marker_index, unnest(list(turn ORDER BY turn)) AS chunk_id, unnest(list(round(1.0::DOUBLE - 0.1 * (i - 1), 1) ORDER BY turn))::DOUBLE AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY 1")
def answer_parts(spark, sf_dir):
    """Citations and media of answers, here the turns of each thread."""
    ids = F.array_sort(F.collect_list("turn"))
    answers = t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("message_id")).agg(ids.alias("chunk_ids"), ids.alias("asset_ids"))
    cited, shown = ingesting.answer_parts(answers)
    return cited.join(shown, (cited.message_id == shown.message_id) & (cited.chunk_id == shown.asset_id)).select(cited.message_id, "marker_index", "chunk_id", "relevance")


@query("SELECT user_id, arg_max(CASE WHEN value < 20 THEN 'failed' ELSE 'ready' END, event_id) AS status FROM events GROUP BY 1")
def document_states(spark, sf_dir):
    """The state machine over a log of states: each user's last event ends it."""
    e = t(spark, sf_dir, "events")
    log = e.select("user_id", "event_id", F.when(F.col("value") < 20, "failed").otherwise("ready").alias("status"))
    return ingesting.document_states(log, "user_id", "event_id").select("user_id", "status")


@query("SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' END AS state FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey")
def active_jobs(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    jobs = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), state.alias("state"), F.col("o_orderdate").alias("created_at"))
    return ingesting.active_jobs(jobs).select("job_id", "state")


@query("WITH s AS (SELECT user_id AS token, max(ts) AS last_seen FROM events GROUP BY 1), n AS (SELECT max(last_seen) AS now FROM s) SELECT token FROM s, n WHERE last_seen + INTERVAL 1 DAY >= now")
def live_sessions(spark, sf_dir):
    """Sessions that are within a day of the log's end."""
    s = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("token")).agg(F.max("ts").alias("last_seen"))
    s = s.withColumn("expires_at", F.col("last_seen") + F.expr("interval 1 day"))
    now = s.agg(F.max("last_seen")).first()[0]
    return ingesting.sessions_after(s, s.where("token % 2 = 0"), F.lit(now)).select("token")


@query("SELECT url, count(*) AS n, max(page_id) AS newest FROM pages GROUP BY 1")
def page_upserts(spark, sf_dir):
    """Pages as keyed writes: the newest of each address counts."""
    rows = t(spark, sf_dir, "pages").groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    newest = explore.latest(t(spark, sf_dir, "pages"), "url", ["page_id"]).select("url", F.col("page_id").alias("newest"))
    return rows.join(newest, "url")


@query("SELECT conv_id, turn, md5(coalesce(lag(text) OVER w, '')) AS before, md5(coalesce(lead(text) OVER w, '')) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_context(spark, sf_dir):
    """Each turn with its neighbours, partitioned by thread."""
    rows = explore.context(t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    md5 = lambda c: F.md5(F.coalesce(c, F.lit("")))
    return rows.select("conv_id", "turn", md5("context_before").alias("before"), md5("context_after").alias("after"))


@query()
def hashed_search(spark, sf_dir):
    """Dense search by the default encoder: documents and questions encoded alike."""
    encode = T.hashed_vector()
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), encode(F.col("text")).alias("embedding"))
    asked = questions(spark, sf_dir).select("query_id", encode(F.col("question")).alias("query_vector"))
    return R.top_k(R.dense_all(cut(docs), cut(asked)), "chunk_id").select("query_id", "chunk_id", "score", "rank")
