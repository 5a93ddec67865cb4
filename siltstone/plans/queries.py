"""Registered queries of the engine over the driver's tables, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import config as C
from siltstone.functions import text as T
from siltstone.operators import answers as A
from siltstone.operators import chat, chunking, explore, graph, ranges
from siltstone.operators import retrieval as R
from siltstone.plans import answering
from siltstone.plans.lineage import cut
from siltstone.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as queries."""
    return t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought in one order: source < target, weight counts orders."""
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    left, right = rows.withColumnRenamed("l_partkey", "source"), rows.withColumnRenamed("l_partkey", "target")
    pairs = left.join(right, "l_orderkey").where("source < target")
    return pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight")).withColumn("predicate", F.lit("BOUGHT_WITH"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, mentions): parts and how many lines name them."""
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count(F.lit(1)).alias("mentions"))


EDGES_SQL = """rows AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
edges AS (SELECT a.l_partkey AS source, b.l_partkey AS target, count(*) AS weight, 'BOUGHT_WITH' AS predicate
  FROM rows a JOIN rows b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2),
parts AS (SELECT l_partkey AS node, count(*) AS mentions FROM lineitem GROUP BY 1)"""

SPLIT_SQL = r"""string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))"""


# ---- chunking and text ----------------------------------------------------------------------------------------------


@query(
    rf"""WITH RECURSIVE p AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(text, '\n\s*\n'), lambda x: trim(x) <> '')) AS text, length(text) <= 3200 AS fits FROM documents WHERE text IS NOT NULL AND length(text) > 0
), s AS (
  SELECT doc_id, row_number() OVER () AS id, length(text) <= 3200 OR fits AS whole, flatten(list_transform({SPLIT_SQL}, lambda x: CASE WHEN length(x) <= 3200 THEN [{{'n': length(x), 'fresh': false}}]
    ELSE list_transform(string_split(x, ' '), lambda w, i: {{'n': length(w), 'fresh': i = 1}}) END)) AS parts FROM p
), walk AS (
  SELECT id, 1 AS i, parts[1].n::BIGINT AS held, 1 AS pieces FROM s WHERE NOT whole
  UNION ALL
  SELECT w.id, w.i + 1, CASE WHEN NOT n.fresh AND w.held + n.n + 1 <= 3200 THEN w.held + n.n + (w.held > 0)::INTEGER ELSE n.n END,
    CASE WHEN NOT n.fresh AND w.held + n.n + 1 <= 3200 THEN w.pieces ELSE w.pieces + 1 END
  FROM (SELECT walk.*, s.parts[walk.i + 1] AS n FROM walk JOIN s USING (id) WHERE walk.i < len(s.parts)) w
), packed AS (SELECT id, max(pieces) AS n FROM walk GROUP BY id)
SELECT doc_id, sum(CASE WHEN whole THEN 1 ELSE n END)::BIGINT AS n_chunks FROM s LEFT JOIN packed USING (id) GROUP BY doc_id"""
)
def chunk_pack(spark, sf_dir):
    """How many pieces each document is packed to."""
    docs = t(spark, sf_dir, "documents").where("text is not null and length(text) > 0")
    return docs.select("doc_id", F.size(chunking.split_long(F.col("text"))).cast("long").alias("n_chunks"))


@query()
def chunk_overlap(spark, sf_dir):
    return chunking.chunks(t(spark, sf_dir, "documents"), ["doc_id"])


@query(
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '-\n', '', 'g'),
  '[ \t\f\v]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS digest FROM documents"""
)
def clean_text(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("digest"))


@query("SELECT lang, source, count(*) AS chunks, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM documents GROUP BY 1, 2")
def chunk_tokens(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("chunks"), F.sum(T.tokens_estimate(F.col("text"))).alias("tokens"))


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def chunk_facets(spark, sf_dir):
    return explore.facet_counts(t(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src0' ORDER BY doc_id LIMIT 20 OFFSET 20")
def doc_browse_page(spark, sf_dir):
    rows = explore.tenant(t(spark, sf_dir, "documents"), source="src0", lang=None)
    return explore.page(rows, ["doc_id"], 20, 20).select("doc_id", "lang", "n_chars")


@query(
    """SELECT doc_id, source, lag(n_chars) OVER w AS before, lead(n_chars) OVER w AS after,
  sha256(coalesce(lag(text) OVER w, '')) AS before_sha FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)"""
)
def context_neighbours(spark, sf_dir):
    near = ranges.neighbours(t(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars"), ["source"], "doc_id", F.struct("text", "n_chars"), 4096)
    text = F.coalesce("before.text", F.lit(""))
    return near.select("doc_id", "source", F.col("before.n_chars").alias("before"), F.col("after.n_chars").alias("after"), F.sha2(text, 256).alias("before_sha"))


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, sf_dir):
    return explore.exact_duplicates(t(spark, sf_dir, "documents"), "text", "doc_id")


@query(
    """WITH f AS (SELECT doc_id AS seq, 'f' || doc_id || CASE WHEN doc_id % 17 = 0 THEN '.exe' ELSE '.txt' END AS name, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents),
e AS (SELECT *, CASE WHEN name LIKE '%.exe' THEN 'extension' WHEN size = 0 THEN 'empty' WHEN size > 20000 THEN 'size' END AS early FROM f),
k AS (SELECT DISTINCT sha256 FROM f JOIN labels ON doc_id = seq WHERE quality = 0)
SELECT seq, coalesce(early, CASE WHEN k.sha256 IS NOT NULL THEN 'known' END,
  CASE WHEN row_number() OVER (PARTITION BY e.sha256, early IS NULL ORDER BY seq) > 1 THEN 'repeated' END) AS reason FROM e LEFT JOIN k USING (sha256)"""
)
def batch_dedup(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 17 == 0, ".exe").otherwise(".txt"))
    files = d.select(F.col("doc_id").alias("seq"), name.alias("name"), F.octet_length("text").alias("size"), F.col("text").cast("binary").alias("head"), F.sha2("text", 256).alias("sha256"))
    known = files.join(t(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("seq")), "seq")
    return explore.staged(files, known, 20_000).select("seq", "reason")


@query(
    r"""SELECT doc_id, CASE WHEN length(f) <= 320 THEN f ELSE rtrim(substr(f, 1, 320)) || '...' END AS snippet
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)"""
)
def snippets(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("SELECT doc_id, CASE WHEN length(text) <= 1200 THEN md5(text) ELSE md5(substr(text, 1, 600) || chr(10) || '...' || chr(10) || right(text, 600)) END AS digest FROM documents")
def condensed(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(T.head_and_tail(F.col("text"))).alias("digest"))


# ---- retrieval ------------------------------------------------------------------------------------------------------

BM25_SQL = """p AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY 1, 2), dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
hits AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM hits)"""


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM lex WHERE rank <= 12")
def bm25_scan_batch(spark, sf_dir):
    """The batch of questions over the texts, without a stored index."""
    found = R.bm25(t(spark, sf_dir, "documents"), questions(spark, sf_dir), "doc_id", "text", "query_id", "question")
    return R.top_k(found.withColumn("score", F.round("score", 6)), "doc_id").select("query_id", "doc_id", "score", "rank")


@query(
    f"""WITH {BM25_SQL} SELECT l.doc_id, l.rank::INTEGER AS rank, CASE WHEN length(f) <= 320 THEN f ELSE rtrim(substr(f, 1, 320)) || '...' END AS snippet
FROM lex l JOIN (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents) d ON d.doc_id = l.doc_id WHERE query_id = 0 AND rank <= 12"""
)
def bm25_scan_topk(spark, sf_dir):
    """One question over the texts: its twelve best documents with snippets."""
    docs = t(spark, sf_dir, "documents")
    found = R.bm25(docs, questions(spark, sf_dir).where("query_id = 0"), "doc_id", "text", "query_id", "question")
    best = R.top_k(found.withColumn("score", F.round("score", 6)), "doc_id").select("doc_id", "rank")
    return docs.join(F.broadcast(best), "doc_id").select("doc_id", "rank", T.snippet(F.col("text")).alias("snippet"))  # twelve rows


@query("SELECT doc_id, term, count(*) AS tf, any_value(dl)::INTEGER AS dl FROM (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)) GROUP BY 1, 2")
def postings(spark, sf_dir):
    return R.postings(t(spark, sf_dir, "documents"), "doc_id", "text")


DENSE_SQL = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sim AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e), 6) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sim)"""


def dense_hits(spark, sf_dir, k: int, scale=None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best rows of the stated queries, ids divisible by 50."""
    v = t(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return R.dense_ranked(v.select(F.col("vec_id").alias("item"), "embedding"), asked, k, scale).withColumnRenamed("item", "vec_id")


@query(f"WITH {DENSE_SQL} SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 12")
def dense_batch_topk(spark, sf_dir):
    """The stated queries, ids divisible by 50, against all rows."""
    v = t(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return R.dense_top(v.select(F.col("vec_id").alias("item"), "embedding"), asked, but_self=True).withColumnRenamed("item", "vec_id")


SECOND_SQL = "other AS (SELECT query_id, vec_id, score2, row_number() OVER (PARTITION BY query_id ORDER BY score2 DESC, vec_id) AS rank FROM (SELECT query_id, vec_id, round(score * (1 + vec_id % 7), 6) AS score2 FROM sim))"


def second_hits(spark, sf_dir, k: int) -> DataFrame:
    """A second ranking of the same pairs, as the lexical branch stands in."""
    return dense_hits(spark, sf_dir, k, 1 + F.col("item") % 7)


@query(
    f"""WITH {DENSE_SQL}, {SECOND_SQL}, u AS (SELECT query_id, vec_id, 1.0::DOUBLE / (1 + rank) AS p FROM ranked WHERE rank <= 24 UNION ALL SELECT query_id, vec_id, 1.0::DOUBLE / (1 + rank) FROM other WHERE rank <= 24),
f AS (SELECT query_id, vec_id, round(sum(p), 9) AS score FROM u GROUP BY 1, 2)
SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM f) WHERE rank <= 12"""
)
def rrf_two_rankings(spark, sf_dir):
    branch = R.over_fetch(C.DEFAULTS.top_k)
    return R.fused(cut(dense_hits(spark, sf_dir, branch)), cut(second_hits(spark, sf_dir, branch)), "vec_id")


@query(f"WITH {DENSE_SQL} SELECT vec_id, max(score) AS score, arg_max(query_id, score * 1000000000 - query_id / 1000000.0) AS query_id FROM ranked WHERE rank <= 6 GROUP BY vec_id")
def multi_query_merge(spark, sf_dir):
    hits = dense_hits(spark, sf_dir, 6).withColumn("seq", F.col("query_id"))
    return R.merged(hits, "vec_id").select("vec_id", "score", "query_id")


@query(
    f"""WITH {DENSE_SQL}, pool AS (SELECT query_id, vec_id, score, rank AS seq, 1 / (1 + exp(-(vec_id % 11 - 5)::DOUBLE)) AS sg, rank > 50 AS tail FROM ranked WHERE rank <= 60),
r AS (SELECT *, CASE WHEN max(sg) OVER w > min(sg) OVER w THEN 0.05 + 0.95 * (sg - min(sg) OVER w) / (max(sg) OVER w - min(sg) OVER w) ELSE 1.0 END AS a,
  CASE WHEN max(score) OVER w > min(score) OVER w THEN 0.05 + 0.95 * (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS b FROM pool WINDOW w AS (PARTITION BY query_id, tail)),
s AS (SELECT query_id, vec_id, tail, seq, CASE WHEN tail THEN score ELSE round(0.6 * a + 0.4 * b, 6) END AS blend FROM r)
SELECT query_id, vec_id, blend FROM s"""
)
def rescale_blend_rerank(spark, sf_dir):
    pool = dense_hits(spark, sf_dir, 60).withColumnRenamed("rank", "seq").withColumn("logit", (F.col("vec_id") % 11 - 5).cast("double"))
    return R.blended(pool).select("query_id", "vec_id", "blend")


@query(f"WITH {DENSE_SQL} SELECT query_id, vec_id, score FROM ranked r WHERE rank <= 12 AND vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def exclude_seen(spark, sf_dir):
    seen = t(spark, sf_dir, "embeddings").where("label = 3")
    return R.excluding(dense_hits(spark, sf_dir, C.DEFAULTS.top_k), seen, "vec_id").select("query_id", "vec_id", "score")


@query()
def answer_loop(spark, sf_dir):
    """The bounded loop over all benchmark items as questions."""
    chunks = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return answering.answer(chunks, questions(spark, sf_dir))


# ---- extraction and graph -------------------------------------------------------------------------------------------

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in C.CAPITALISED_STOPWORDS) + "]"
#: Word borders are those of Unicode words in the engine and of ASCII ones in the SQL: there, runs of letters, digits, _ and -
#: are taken first, and only runs of ASCII can hold a name.
RUNS_SQL = r"list_filter(regexp_extract_all(text, '[\pL\pN\pM_-]+'), lambda r: NOT regexp_matches(r, '[^\x00-\x7F]'))"


def found_sql(pattern: str) -> str:
    return f"flatten(list_transform({RUNS_SQL}, lambda r: regexp_extract_all(r, '{pattern}')))"


FOUND_SQL = rf"list_concat({found_sql(T.CAPITALISED)}, {found_sql(T.ACRONYM)})"
NAMES_SQL = f"list_filter(list_distinct({FOUND_SQL}), lambda x: NOT list_contains({STOP_SQL}, x))"


@query(
    rf"""WITH d AS (SELECT doc_id, len({NAMES_SQL}) AS names, len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS words FROM documents WHERE trim(text) <> '')
SELECT doc_id, round(CASE WHEN words < 20 THEN 0.0 ELSE names / greatest(1.0, words / 100.0) END, 6)::DOUBLE AS density, words >= 20 AND names / greatest(1.0, words / 100.0) >= 4 AS eligible FROM d"""
)
def entity_density(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").where("trim(text) <> ''")
    return docs.select("doc_id", F.round(T.entity_density(F.col("text")), 6).alias("density"), T.worth_extracting(F.col("text")).alias("eligible"))


ENTITIES_SQL = rf"""found AS (SELECT doc_id, list_filter({FOUND_SQL}, lambda x: NOT list_contains({STOP_SQL}, x)) AS w FROM documents),
named AS (SELECT doc_id, unnest(w) AS name, generate_subscripts(w, 1) AS place FROM found),
norm AS (SELECT doc_id, name, place, regexp_replace(regexp_replace(regexp_replace(lower(name), '^the ', ''), '^a ', ''), '^an ', '') AS norm_name FROM named),
firsts AS (SELECT doc_id, norm_name, arg_min(name, place) AS name, min(place) AS place FROM norm WHERE norm_name <> '' GROUP BY 1, 2),
ents AS (SELECT * FROM (SELECT doc_id, norm_name, name, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS seq FROM firsts) WHERE seq <= 10),
pairs AS (SELECT * FROM (SELECT doc_id, seq, norm_name AS source, lead(norm_name) OVER (PARTITION BY doc_id ORDER BY seq) AS target FROM ents) WHERE target IS NOT NULL AND source <> target AND seq <= 8)"""


def entity_rows(spark, sf_dir) -> DataFrame:
    return graph.extracted(t(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {ENTITIES_SQL} SELECT doc_id, seq::INTEGER AS seq, name, norm_name FROM ents")
def heuristic_entities(spark, sf_dir):
    return entity_rows(spark, sf_dir)


@query(f"WITH {ENTITIES_SQL} SELECT norm_name, arg_min(name, doc_id * 100 + seq) AS name, count(*) AS mentions FROM ents GROUP BY 1")
def entity_upsert(spark, sf_dir):
    return graph.upsert_entities(entity_rows(spark, sf_dir)).select("norm_name", "name", "mentions")


@query(f"WITH {ENTITIES_SQL} SELECT source, 'CO_MENTIONED_WITH' AS predicate, target, count(*) AS weight, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS n_docs FROM pairs GROUP BY source, target")
def relation_upsert(spark, sf_dir):
    return graph.upsert_relations(graph.co_mentions(entity_rows(spark, sf_dir)))


@query(f"WITH {ENTITIES_SQL} SELECT norm_name FROM ents JOIN documents USING (doc_id) GROUP BY 1 HAVING bool_and(source = 'src0')")
def orphan_entities(spark, sf_dir):
    """Entities that nothing mentions once the documents of one source are deleted."""
    rows = entity_rows(spark, sf_dir)
    rest = t(spark, sf_dir, "documents").where("source <> 'src0'").select("doc_id")
    return graph.orphans(rows.select("norm_name").distinct(), rows.join(rest, "doc_id", "left_semi"))


@query(f"WITH {EDGES_SQL} SELECT greatest(10.0, quantile_cont(mentions, 0.99))::DOUBLE AS cutoff FROM parts")
def hub_cutoff(spark, sf_dir):
    return graph.hub_cutoff(parts(spark, sf_dir))


@query("SELECT l_suppkey, greatest(10.0, 8.0 * list_sort(list(n))[count(*) // 2 + 1])::DOUBLE AS hub_at FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def hub_median(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return graph.hub_thresholds(rows, ["l_suppkey"], "n")


@query(
    """WITH l AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS line, epoch(l_shipdate::TIMESTAMP)::BIGINT // 86400 AS lo, epoch(l_shipdate::TIMESTAMP)::BIGINT // 86400 + l_quantity::BIGINT AS hi FROM lineitem)
SELECT a.l_suppkey, count(*) AS pairs, sum(least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1)::BIGINT AS days FROM l a JOIN l b ON a.l_suppkey = b.l_suppkey AND a.line < b.line AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY 1"""
)
def interval_overlaps(spark, sf_dir):
    """Lines of a supplier that are under way at one time, a day for each piece from shipping on; intervals met in bands."""
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    rows = t(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), day("l_shipdate").alias("lo"), (day("l_shipdate") + F.col("l_quantity").cast("long")).alias("hi"))
    met = ranges.overlapping(rows, rows.withColumnRenamed("line", "other"), ["l_suppkey"], 30).where("line < other")
    days = F.least("hi", "r_hi") - F.greatest("lo", "r_lo") + 1
    return met.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum(days).alias("days"))


@query(
    """WITH l AS (SELECT l_suppkey, l_orderkey, epoch(l_shipdate::TIMESTAMP)::BIGINT // 86400 AS d FROM lineitem), r AS (SELECT l_suppkey, epoch(l_shipdate::TIMESTAMP)::BIGINT // 86400 + l_quantity::BIGINT AS d, max(l_orderkey) AS m FROM lineitem GROUP BY 1, 2)
SELECT l.l_suppkey, count(*) AS lines, count(r.d) AS after_one, sum(l.d - r.d)::BIGINT AS days, sum(r.m)::BIGINT AS marks FROM l ASOF LEFT JOIN r ON l.l_suppkey = r.l_suppkey AND l.d >= r.d GROUP BY 1"""
)
def arrivals_before(spark, sf_dir):
    """For each line the supplier's newest arrival at or before its shipping, as-of by sorted blocks."""
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    lines = t(spark, sf_dir, "lineitem")
    rows = lines.select("l_suppkey", day("l_shipdate").alias("d"), "l_orderkey")
    marks = lines.select("l_suppkey", (day("l_shipdate") + F.col("l_quantity").cast("long")).alias("d"), F.col("l_orderkey").alias("mark"))
    found = ranges.as_of(rows, marks, ["l_suppkey"], "d", 365)
    return found.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"), F.count("mark_at").alias("after_one"), F.sum(F.col("d") - F.col("mark_at")).alias("days"), F.sum("mark").alias("marks"))


@query(f"WITH {EDGES_SQL} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1")
def degree(spark, sf_dir):
    return graph.degree(edges(spark, sf_dir))


@query(f"WITH {EDGES_SQL}, g AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1) SELECT node, mentions, degree, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY degree DESC, mentions DESC, node) AS rank FROM parts JOIN g USING (node)) WHERE rank <= 150")
def overview(spark, sf_dir):
    return graph.overview(parts(spark, sf_dir), edges(spark, sf_dir)).select("node", "mentions", "degree", "rank")


@query("SELECT p_brand AS facet, count(*) AS n FROM part GROUP BY 1")
def facets_types(spark, sf_dir):
    return graph.facets(t(spark, sf_dir, "part"), F.coalesce("p_brand", F.lit("OTHER")))


@query("SELECT p_type AS facet, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, facet LIMIT 80")
def facets_predicates(spark, sf_dir):
    return graph.facets(t(spark, sf_dir, "part"), F.col("p_type"), 80)


KHOP_SQL = f"""WITH {EDGES_SQL}, cut AS (SELECT greatest(10.0, quantile_cont(mentions, 0.99)) AS c FROM parts), hub AS (SELECT node FROM parts, cut WHERE mentions >= c),
s0 AS (SELECT node FROM parts WHERE node <= 5), ways AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges),
front AS (SELECT node FROM s0 UNION SELECT b FROM ways JOIN s0 ON a = s0.node WHERE b NOT IN (SELECT node FROM s0) AND b NOT IN (SELECT node FROM hub)),
hop AS (SELECT source, target, weight FROM edges WHERE (source IN (SELECT node FROM front) OR target IN (SELECT node FROM front)) AND NOT (source IN (SELECT node FROM hub) AND target IN (SELECT node FROM hub)))"""


@query(f"{KHOP_SQL} SELECT * FROM hop")
def khop_edges(spark, sf_dir):
    """All edges within two hops, a row each."""
    start = parts(spark, sf_dir).where("node <= 5").select("node")
    return graph.khop_edges(cut(edges(spark, sf_dir)), cut(parts(spark, sf_dir)), start, 2, None).select("source", "target", "weight")


@query(f"{KHOP_SQL} SELECT source, target, weight FROM hop ORDER BY weight DESC, source, target LIMIT 80")
def khop_top_edges(spark, sf_dir):
    start = parts(spark, sf_dir).where("node <= 5").select("node")
    return graph.khop_edges(cut(edges(spark, sf_dir)), cut(parts(spark, sf_dir)), start).select("source", "target", "weight")


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, ways AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges),
d0 AS (SELECT 1::BIGINT AS node), d1 AS (SELECT DISTINCT b AS node FROM ways WHERE a = 1 AND b <> 1),
d2 AS (SELECT DISTINCT b AS node FROM ways WHERE a IN (SELECT node FROM d1) AND b NOT IN (SELECT node FROM d1) AND b <> 1)
SELECT node, 0 AS depth FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2"""
)
def bfs_depths(spark, sf_dir):
    return graph.frontiers(cut(edges(spark, sf_dir)), spark.sql("select 1L as node"), 2)


@query(f"WITH {EDGES_SQL}, ways AS (SELECT source AS a, target AS b, weight FROM edges UNION ALL SELECT target, source, weight FROM edges) SELECT b AS node, sum(weight)::BIGINT AS strength FROM ways WHERE a <= 3 AND b > 3 GROUP BY 1")
def one_hop_neighbours(spark, sf_dir):
    return graph.neighbours(edges(spark, sf_dir), parts(spark, sf_dir).where("node <= 3"))


@query(f"WITH {EDGES_SQL}, top AS (SELECT node FROM parts ORDER BY mentions DESC, node LIMIT 150) SELECT source, predicate, target, weight FROM edges WHERE source IN (SELECT node FROM top) AND target IN (SELECT node FROM top) ORDER BY weight DESC, source, target LIMIT 600")
def induced_subgraph(spark, sf_dir):
    """The explorer's view: edges between the 150 most mentioned parts, 600 at most."""
    top = parts(spark, sf_dir).orderBy(F.desc("mentions"), "node").limit(150)
    return graph.induced(edges(spark, sf_dir), top).select("source", "predicate", "target", "weight")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND p_brand = 'Brand#11' ORDER BY p_name, p_partkey LIMIT 50")
def entity_search_substring(spark, sf_dir):
    rows = explore.tenant(t(spark, sf_dir, "part"), p_brand="Brand#11").where(F.contains(F.lower("p_name"), F.lit("a")))
    return explore.page(rows, ["p_name", "p_partkey"], 50).select("p_partkey", "p_name")


# ---- conversations --------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 3 AND text <> ''")
def history_last3(spark, sf_dir):
    return chat.last_turns(t(spark, sf_dir, "conversations"), "conv_id", "turn", 3, F.col("text") != "").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 8")
def history_last8(spark, sf_dir):
    return chat.last_turns(t(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


ISLAND_SQL = "isl AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM conversations)"


@query(f"WITH {ISLAND_SQL} SELECT conv_id, turn, island FROM isl")
def turn_islands(spark, sf_dir):
    return chat.islands(t(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "island")


@query(f"WITH {ISLAND_SQL}, first AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1) SELECT conv_id, turn, role FROM isl i WHERE NOT EXISTS (SELECT 1 FROM first f JOIN isl g ON g.conv_id = f.conv_id AND g.turn = f.turn WHERE g.conv_id = i.conv_id AND g.island = i.island)")
def delete_turn(spark, sf_dir):
    """Every thread's first question is deleted with its answers."""
    rows = t(spark, sf_dir, "conversations")
    first = rows.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("turn"))
    return chat.after_deletion(rows, first, "conv_id", "turn").select("conv_id", "turn", "role")


@query(
    r"""SELECT conv_id, count(*) AS n_messages, coalesce(nullif(rtrim(substr(trim(regexp_replace(arg_min(text, turn) FILTER (WHERE role = 'user'), '\s+', ' ', 'g')), 1, 60)), ''), 'New chat') AS title
FROM conversations GROUP BY 1"""
)
def first_question_title(spark, sf_dir):
    return chat.titles(t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(
    """WITH c AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c)
SELECT conv_id, run, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n FROM r GROUP BY 1, 2, 3"""
)
def merged_turns(spark, sf_dir):
    return chat.merged_roles(t(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query(
    """SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || substr(text, 1, 500), chr(10) ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 6 GROUP BY 1"""
)
def transcripts(spark, sf_dir):
    return chat.transcript(t(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def _marks_sql(marks) -> str:
    return " + ".join(f"contains(p, '{m}')::INTEGER" for m in marks)


@query(
    rf"""WITH q AS (SELECT conv_id, turn, trim(text) AS x, ' ' || lower(trim(text)) || ' ' AS p, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM conversations WHERE role = 'user'),
f AS (SELECT *, {_marks_sql(C.MULTIHOP_MARKERS)} AS m, {_marks_sql(C.RELATION_MARKERS)} AS r, len(list_filter(w[2:], lambda t: regexp_matches(t, '^[A-Z]') AND length(t) > 2)) AS n,
  ({" OR ".join(f"starts_with(lower(x), '{s}')" for s in C.LOOKUP_STARTS)}) AS l FROM q)
SELECT conv_id, turn, CASE WHEN x = '' OR regexp_matches(x, '{C.GREETING}') OR (regexp_matches(x, '{C.META}') AND len(w) <= 12) THEN 'DIRECT'
  WHEN m >= 1 AND (n >= 2 OR m >= 2) THEN 'MULTIHOP' WHEN r >= 1 AND n >= 2 THEN 'GRAPH' WHEN l AND r = 0 AND m = 0 AND n <= 1 THEN 'VECTOR' ELSE 'HYBRID' END AS route FROM f"""
)
def route_heuristic(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", A.route(F.col("text")).alias("route"))


@query(
    rf"""SELECT conv_id, turn, turn > 0 AND (length(trim(text)) < 12 OR len(list_filter(regexp_extract_all(lower(text), '[\pL\pN\pM_]+'), lambda w: w IN ({", ".join(f"'{w}'" for w in C.REFERENCE_WORDS)}))) > 0
  OR {" OR ".join(f"contains(lower(text), '{p}')" for p in C.REFERENCE_PHRASES)}) AS rewrite FROM conversations WHERE role = 'user'"""
)
def needs_rewrite(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", A.needs_rewrite(F.col("text"), F.col("turn") > 0).alias("rewrite"))


# ---- evidence and answers -------------------------------------------------------------------------------------------


@query(
    """WITH v AS (SELECT user_id, event_id, (event_id % 100) / 100.0::DOUBLE AS score FROM events),
o AS (SELECT *, lag(score) OVER w AS previous, max(score) OVER w AS best_score, arg_max(event_id, score * 1000000000 + event_id) OVER w AS best_pass FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, previous, best_score, best_pass, CASE WHEN previous IS NULL OR score - previous >= 0.05 THEN NULL WHEN score < 0.25 THEN 'out_of_scope' ELSE 'stalled' END AS stop FROM o"""
)
def verdict_stop(spark, sf_dir):
    v = t(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") % 100) / 100.0).alias("score"))
    o = A.with_previous(v, "user_id", "event_id")
    stop = A.stop_reason(F.col("score"), F.col("previous"), F.lit(None).cast("boolean"), F.lit("prose"), F.lit(False))
    return o.select("event_id", "previous", "best_score", "best_pass", stop.alias("stop"))


@query()
def grounding(spark, sf_dir):
    """Grounding of assistant turns, a marker put behind every second sentence."""
    rows = t(spark, sf_dir, "conversations").where("role = 'assistant'")
    cited = F.regexp_replace("text", r"([.!?]) (\S+ [^.!?]*)([.!?])", "$1 $2$3 [1]")
    return rows.select("conv_id", "turn", A.grounding(cited, F.lit(1)).alias("grounding"))


@query()
def citation_renumber(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").where("role = 'assistant'")
    text = F.concat(F.col("text"), F.lit(" [7]. Then [3] and [7], but not [99]."))
    return rows.select("conv_id", "turn", A.renumbered(text, F.lit(9)).alias("answer"), A.markers(text, F.lit(9)).alias("used"))


# ---- browse, jobs, streams ------------------------------------------------------------------------------------------


@query(
    """WITH j AS (SELECT user_id, sum((event_type <> 'error' AND value >= 20)::INTEGER)::BIGINT AS done, sum((value < 20)::INTEGER)::BIGINT AS failed, max(60) AS total FROM events GROUP BY 1)
SELECT user_id, done + failed AS processed, failed, total::INTEGER AS total, round(least(1.0, (done + failed) / total), 3)::DOUBLE AS progress,
  CASE WHEN done + failed = 0 THEN 'queued' WHEN done + failed < total THEN 'running' WHEN failed = 0 THEN 'completed' WHEN done = 0 THEN 'failed' ELSE 'completed_with_errors' END AS state FROM j"""
)
def job_rollup(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return explore.job_states(e, "user_id", (F.col("event_type") != "error") & (F.col("value") >= 20), F.col("value") < 20, F.lit(60))


@query(
    """SELECT lang, count(*) AS documents, sum((doc_id % 4 <= 1)::INTEGER)::BIGINT AS ready, sum((doc_id % 4 = 2)::INTEGER)::BIGINT AS failed, sum((doc_id % 4 = 3)::INTEGER)::BIGINT AS pending,
  sum(n_chars)::BIGINT AS total_bytes, coalesce(sum(CASE WHEN doc_id % 4 <= 1 THEN n_chars // 100 END), 0)::BIGINT AS chunks FROM documents GROUP BY 1"""
)
def kb_counters(spark, sf_dir):
    status = F.when(F.col("doc_id") % 4 <= 1, "ready").when(F.col("doc_id") % 4 == 2, "failed").otherwise("parsing")
    return explore.counters(t(spark, sf_dir, "documents"), ["lang"], status, F.col("n_chars"), F.floor(F.col("n_chars") / 100))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def progress_changes(spark, sf_dir):
    return explore.changes(t(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type")).select("event_id", "user_id", "event_type")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_state(spark, sf_dir):
    return explore.latest(t(spark, sf_dir, "events"), "user_id", ["event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'k = ' || json_extract_string(props, '$.k') AS line FROM events")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return t(spark, sf_dir, "events").select("event_id", k.cast("long").alias("k"), F.concat(F.lit("k = "), k).alias("line"))


@query("WITH f AS (SELECT array_to_string(json_keys(props), ', ') AS s FROM events), c AS (SELECT s, count(*) AS n FROM f GROUP BY 1) SELECT (SELECT sum(n) FROM c)::BIGINT AS passages, arg_max(s, n) AS common, max(n) AS common_n FROM c")
def corpus_signature_mode(spark, sf_dir):
    rows = t(spark, sf_dir, "events")
    out = explore.field_signatures(rows, F.concat(F.lit("[0]."), F.regexp_extract("props", r'"(\w+)"', 1), F.lit(" =")))
    return out.select("passages", "common", "common_n")


@query("SELECT count(*) AS passages, count(DISTINCT source) AS files, min(CASE WHEN doc_id > 0 THEN doc_id END) AS first_page, max(doc_id) AS last_page, (SELECT string_agg(n || ' ' || lang, ', ' ORDER BY n DESC, lang) FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)) AS kinds FROM documents")
def prose_profile(spark, sf_dir):
    return explore.prose_profile(t(spark, sf_dir, "documents"), F.col("source"), F.col("doc_id"), F.col("lang"))


@query("SELECT source, string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id) FILTER (WHERE n <= 6) || CASE WHEN max(total) > 6 THEN ' and ' || (max(total) - 6) || ' more' ELSE '' END AS profile FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS total FROM documents) GROUP BY 1")
def corpus_profile(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").withColumn("name", F.col("doc_id").cast("string"))
    return explore.profile_line(rows, "source", "name", "doc_id")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_documents(spark, sf_dir):
    return explore.orphaned(t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT o_orderkey, o_orderstatus, coalesce(c_name, 'unknown') AS owner FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def owner_names(spark, sf_dir):
    owners = t(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_name").alias("owner"))
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return explore.with_name(orders, owners, "o_custkey", "c_custkey", "owner", "unknown").drop("o_custkey")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, t, i, 1.0::DOUBLE AS tokens, true AS allowed FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.t, e.i,
    least(2.0, w.tokens + (e.t - w.t) * 0.05 / 60.0) - CASE WHEN least(2.0, w.tokens + (e.t - w.t) * 0.05 / 60.0) >= 1 THEN 1 ELSE 0 END,
    least(2.0, w.tokens + (e.t - w.t) * 0.05 / 60.0) >= 1
  FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id AS key, event_id AS event, allowed FROM w"""
)
def token_bucket(spark, sf_dir):
    return ingest.limited(t(spark, sf_dir, "events"), "user_id", "ts", "event_id", rate=0.05, burst=2.0)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    """An extension: event-time windows, here over the table as a batch."""
    e = t(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.count(F.lit(1)).alias("n"))


from siltstone.plans import queries_kb  # noqa: E402, F401  registers its queries
