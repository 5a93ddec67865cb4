"""Conversation history: last turns, turn islands, deletions, titles, nested messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.config import DEFAULTS
from siltstone.functions import text as T


def last_turns(messages: DataFrame, session: str, at: str, n: int = DEFAULTS.history_turns, usable: Column | None = None) -> DataFrame:
    """The newest n messages of each session; unusable ones are dropped after the cut, so fewer may stay."""
    newest = Window.partitionBy(session).orderBy(F.desc(at))
    kept = messages.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n)
    return kept if usable is None else kept.where(usable)


def islands(messages: DataFrame, session: str, at: str, role: str = "role") -> DataFrame:
    """Adds island: the number of user messages so far; a question and what follows it share one."""
    order = Window.partitionBy(session).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("island", F.sum((F.col(role) == "user").cast("int")).over(order))


def after_deletion(messages: DataFrame, deleted: DataFrame, session: str, at: str, role: str = "role") -> DataFrame:
    """Messages left when those of ``deleted`` (session, at) go: a question takes its island, an answer only itself."""
    marked = islands(messages, session, at, role)
    gone = marked.join(deleted.select(session, at), [session, at], "left_semi")
    turns = gone.where(F.col(role) == "user").select(session, "island")
    single = gone.where(F.col(role) != "user").select(session, at)
    return marked.join(turns, [session, "island"], "left_anti").join(single, [session, at], "left_anti").select(*messages.columns)


def titles(messages: DataFrame, session: str, at: str, text: str, role: str = "role") -> DataFrame:
    """(session, title, n_messages): the first question's beginning, or the default."""
    first = F.min_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", F.col(at)))
    rows = messages.groupBy(session).agg(first.alias("q"), F.count(F.lit(1)).alias("n_messages"))
    return rows.select(session, T.fallback_title(F.col("q")).alias("title"), "n_messages")


def merged_roles(messages: DataFrame, session: str, at: str, role: str, text: str) -> DataFrame:
    """Neighbours of one role become one message: (session, run, role, text, n)."""
    order = Window.partitionBy(session).orderBy(at)
    change = F.coalesce((F.lag(role).over(order) != F.col(role)).cast("int"), F.lit(1))
    runs = messages.withColumn("new", change).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct(at, F.col(text).alias("t"))))
    return runs.groupBy(session, "run", role).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("n"))


def transcript(messages: DataFrame, session: str, at: str, role: str, text: str, n: int = 6, chars: int = 500) -> DataFrame:
    """(session, history): the last n turns, each cut, under speaker labels."""
    last = last_turns(messages, session, at, n)
    line = F.concat(F.when(F.col(role) == "user", "User: ").otherwise("Assistant: "), F.substring(text, 1, chars))
    rows = F.array_sort(F.collect_list(F.struct(at, line.alias("t"))))
    return last.groupBy(session).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("history"))


def summary_due(n: Column) -> Column:
    return (n >= 12) & (n % 6 == 0)


def nested(messages: DataFrame, citations: DataFrame, media: DataFrame, assets: DataFrame) -> DataFrame:
    """Messages with citations in marker order and media in falling relevance; media of deleted assets are left out."""
    cited = citations.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("marker_index", "chunk_id"))).alias("citations"))
    shown = media.join(assets.select("asset_id", "rel_path"), "asset_id").groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("order"), "asset_id", "rel_path"))).alias("media"))
    return messages.join(cited, "message_id", "left").join(shown, "message_id", "left")


def media_relevance(ids: Column) -> Column:
    return F.transform(ids, lambda a, i: F.struct(a.alias("asset_id"), F.round(1.0 - 0.1 * i, 1).alias("relevance")))
