"""Files to a searchable knowledge base as one plan: rows, blocks, chunks, index, graph, states; and the keyed writes of chats,
knowledge bases, jobs and sessions.

States and errors are columns: a file that can't be parsed is a row with its error and never stops the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.config import DEFAULTS as D
from siltstone.functions import text as T
from siltstone.operators import chunking, explore, graph
from siltstone.plans.lineage import cut
from siltstone.sources import files as S
from siltstone.sources.index import Index


def document_rows(files: DataFrame, kb_id: str, user_id: str, created: Column | None = None) -> DataFrame:
    """A pending document for each file (path, content): id by owner, place and content."""
    name = F.regexp_extract("path", "[^/]+$", 0)
    rows = files.select("path", name.alias("filename"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))
    return rows.select(
        F.xxhash64(F.lit(kb_id), F.lit(user_id), "path", "sha256").alias("doc_id"), F.lit(kb_id).alias("kb_id"), F.lit(user_id).alias("user_id"), "path", "filename",
        T.ending(F.col("filename")).alias("ext"), T.mime(F.col("filename")).alias("mime"), "size", "sha256", F.lit("pending").alias("status"), (created if created is not None else F.current_timestamp()).alias("created_at"),
    )


@dataclass(frozen=True)
class Ingested:
    documents: DataFrame
    chunks: DataFrame
    entities: DataFrame
    relations: DataFrame
    mentions: DataFrame
    events: DataFrame


def ingest(files: DataFrame, kb_id: str, user_id: str, index: Index | None = None, mode: str = "selective", embed=None) -> Ingested:
    """Stages files, parses and chunks them, writes the index and builds the graph. Vectors are written before the documents
    count as ready. A file without a parser or without text fails with a message."""
    docs = cut(document_rows(files, kb_id, user_id))
    parsed = S.blocks(files).join(docs.select("path", "doc_id"), "path")
    if "page_no" not in parsed.columns:
        parsed = parsed.withColumn("page_no", F.lit(None).cast("int"))
    parsed = cut(parsed)
    made = chunking.merged_blocks(parsed.where("error is null").select("doc_id", "seq", "text", "page_no", "section", "modality"))
    made = made.withColumn("chunk_id", F.xxhash64("doc_id", "ordinal")).withColumnRenamed("chunk_text", "text")
    chunks = cut(made.join(docs.select("doc_id", "kb_id", "user_id", "filename"), "doc_id"))
    if index is not None:
        rows = chunks.select("chunk_id", "text") if embed is None else chunks.select("chunk_id", "text", embed(F.col("text")).alias("embedding"))
        index.upsert(rows, vector=None if embed is None else "embedding")
    entities, relations, mentions = graph_of(chunks, mode)
    sizes = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("text_length"))
    errors = parsed.groupBy("doc_id").agg(F.min("error").alias("error"))
    out = docs.drop("status").join(sizes, "doc_id", "left").join(errors, "doc_id", "left")
    out = out.withColumn("chunks", F.coalesce("chunks", F.lit(0))).withColumn("error", F.coalesce("error", F.when(F.col("chunks") == 0, "no text")))
    out = cut(out.withColumn("status", F.when(F.col("error").isNull(), "ready").otherwise("failed")))
    return Ingested(out, chunks, entities, relations, mentions, state_events(out))


def graph_of(chunks: DataFrame, mode: str = "selective", chars: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, mentions) of eligible chunks (chunk_id, doc_id, ordinal, text); chunks carry a snippet."""
    fit = chunks.where(T.worth_extracting(F.col("text"), mode))
    found = cut(graph.extracted(fit, "chunk_id", "text").withColumnRenamed("doc_id", "chunk_id"))
    rows = found.withColumnRenamed("chunk_id", "doc_id")
    pairs = graph.co_mentions(rows)
    entities = graph.upsert_entities(rows)
    mentions = found.groupBy("norm_name", "chunk_id").agg(F.count(F.lit(1)).alias("n")).join(fit.select("chunk_id", "doc_id", F.substring("text", 1, chars).alias("snippet")), "chunk_id")
    return entities, graph.upsert_relations(pairs), mentions


def rebuilt_graph(stored: DataFrame, kb_id: str, mode: str = "selective") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of a knowledge base from its stored chunks; what was there before is not read, so it is replaced as a whole."""
    return graph_of(stored.where(F.col("kb_id") == kb_id), mode)


STEPS = ("pending", "parsing", "embedding", "graphing")


def state_events(documents: DataFrame) -> DataFrame:
    """(doc_id, step, status): the states that each document went through; failures end after parsing."""
    way = F.when(F.col("status") == "failed", F.array(*[F.lit(s) for s in ("pending", "parsing", "failed")])).otherwise(F.array(*[F.lit(s) for s in (*STEPS, "ready")]))
    return documents.select("doc_id", F.posexplode(way).alias("step", "status"))


ALLOWED = {"pending": ("parsing", "failed"), "parsing": ("embedding", "failed"), "embedding": ("graphing", "ready", "failed"), "graphing": ("ready", "failed")}


def document_states(events: DataFrame, key: str = "doc_id", at: str = "step", status: str = "status") -> DataFrame:
    """(key, status, broken): the newest state of each document, and how many of its steps aren't in the machine."""
    order = Window.partitionBy(key).orderBy(at)
    before = F.lag(status).over(order)
    fits = F.lit(False)
    for a, to in ALLOWED.items():
        fits = fits | ((before == a) & F.col(status).isin(*to))
    rows = events.withColumn("odd", F.when(before.isNull(), F.col(status) != "pending").otherwise(~fits & (before != F.col(status))))
    return rows.groupBy(key).agg(F.max_by(status, at).alias("status"), F.sum(F.col("odd").cast("long")).alias("broken"))


# ---- jobs, sessions, knowledge bases, metadata ----------------------------------------------------------------------


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that are queued or running, newest first."""
    return jobs.where(F.col("state").isin("queued", "running")).orderBy(F.desc("created_at"), "job_id")


def sessions_after(sessions: DataFrame, requests: DataFrame, now: Column, idle_s: int = 300) -> DataFrame:
    """Sessions (token, last_seen, expires_at) that haven't expired; one that was used is touched if its last sight is older
    than ``idle_s``. Requests are (token)."""
    used = requests.select("token").distinct().withColumn("used", F.lit(True))
    live = sessions.where(F.col("expires_at") >= now).join(used, "token", "left")
    stale = F.col("used") & (F.unix_timestamp(now) - F.unix_timestamp("last_seen") > idle_s)
    return live.withColumn("last_seen", F.when(stale, now).otherwise(F.col("last_seen"))).drop("used")


def saved_bases(stored: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bases, refused): rows (kb_id, user_id, name) are created, or renamed where the kb_id is stored. Names are trimmed, 1 to
    120 characters, one of a kind for each user; of asked rows with equal names the first kb_id wins."""
    rows = asked.withColumn("name", F.trim("name"))
    bad = F.when(F.coalesce(F.length("name"), F.lit(0)) == 0, "empty name").when(F.length("name") > 120, "long name")
    first = F.row_number().over(Window.partitionBy("user_id", "name").orderBy("kb_id"))
    taken = stored.select("user_id", "name", F.col("kb_id").alias("other"))
    rows = rows.withColumn("first", first).join(taken, ["user_id", "name"], "left")
    rows = rows.withColumn("reason", F.coalesce(bad, F.when((F.col("first") > 1) | (F.col("other") != F.col("kb_id")), "name is taken")))
    good = rows.where("reason is null").select("kb_id", "user_id", "name")
    kept = stored.join(good.select("kb_id"), "kb_id", "left_anti").select("kb_id", "user_id", "name")
    return kept.unionByName(good), rows.where("reason is not null").select("kb_id", "user_id", "name", "reason")


def metadata(stored: DataFrame, written_: DataFrame) -> DataFrame:
    """(key, value) after writes (key, value, at): the newest write of a key counts."""
    newest = written_.groupBy("key").agg(F.max_by("value", "at").alias("value"))
    return stored.join(newest.select("key"), "key", "left_anti").select("key", "value").unionByName(newest)


# ---- chat writes ----------------------------------------------------------------------------------------------------


def saved_messages(sessions: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with ids, sessions with their counts): messages (session_id, at, role, text) are appended."""
    rows = messages.withColumn("message_id", F.xxhash64("session_id", "at", "role", "text"))
    added = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("added"))
    return rows, sessions.join(added, "session_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)) + F.coalesce("added", F.lit(0))).drop("added")


def answer_parts(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(citations, media) of answers (message_id, chunk_ids, asset_ids): markers from 1, relevance falling by a tenth."""
    cited = answers.select("message_id", F.posexplode("chunk_ids").alias("at", "chunk_id")).select("message_id", (F.col("at") + 1).alias("marker_index"), "chunk_id")
    shown = answers.select("message_id", F.posexplode("asset_ids").alias("at", "asset_id")).select("message_id", "asset_id", F.round(1.0 - 0.1 * F.col("at"), 1).alias("relevance"))
    return cited, shown


# ---- projections ----------------------------------------------------------------------------------------------------


def stored_chunks(points: DataFrame, origin: str = "vector") -> DataFrame:
    """Stored points as chunks, with defaults for what is missing or empty."""
    text = lambda c, d: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(d))
    return points.select("chunk_id", "doc_id", text("filename", "unknown").alias("filename"), F.coalesce("text", F.lit("")).alias("text"), text("modality", "text").alias("modality"), F.coalesce("ordinal", F.lit(0)).alias("ordinal"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(origin).alias("origin"))


def points(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dense, sparse, payload): empty vectors are left out."""
    fields = [c for c in ("kb_id", "user_id", "doc_id", "filename", "text", "modality", "page_no", "section", "ordinal", "token_count", "media_refs") if c in chunks.columns]
    some = lambda c: F.when(F.size(c) > 0, F.col(c)) if c in chunks.columns else F.lit(None)
    return chunks.select("chunk_id", some("dense").alias("dense"), some("sparse").alias("sparse"), F.struct(*fields).alias("payload"))


def sample(chunks: DataFrame, most: int = 200) -> DataFrame:
    """The first chunks by id: a fixed sample for a corpus profile, no random one."""
    return chunks.orderBy("chunk_id").limit(most)


def with_tokens(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their token counts, 0 where unknown, and scores of five places."""
    return hits.join(chunks.select("chunk_id", "token_count"), "chunk_id", "left").withColumn("token_count", F.coalesce("token_count", F.lit(0))).withColumn("score", F.round("score", 5))


def media_rows(assets: DataFrame) -> DataFrame:
    """(asset_id, url, caption): the caption, else the first 200 characters of the text read from the image."""
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    return assets.select("asset_id", F.concat(F.lit("/media/"), "asset_id").alias("url"), F.coalesce(blank("caption"), F.substring(blank("ocr_text"), 1, 200)).alias("caption"))


def newest(rows: DataFrame, at: str = "created_at", key: str = "id", cap: int | None = None) -> DataFrame:
    out = rows.orderBy(F.desc(at), key)
    return out.limit(cap) if cap else out


def usage(calls: DataFrame, *keys: str) -> DataFrame:
    """Token counts of model calls, summed."""
    names = ("prompt_tokens", "completion_tokens", "total_tokens", "calls")
    return calls.groupBy(*keys).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def budget_note(main: Column, fast: Column, seconds: Column, most_main: int = 6, most_fast: int = 12, most_s: float = 45.0) -> Column:
    """The first budget that is spent: main calls, then fast calls, then time; null if none."""
    return F.when(main >= most_main, "main calls spent").when(fast >= most_fast, "fast calls spent").when(seconds >= most_s, "time spent")
