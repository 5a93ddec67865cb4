"""The entity graph: extraction, upserts, facets, hub rules, traversal.

Edges are (source, predicate, target, weight). Traversals are bounded loops of frontier joins; frontiers and results are
DataFrames, and paths are never enumerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import config as C
from siltstone.functions import text as T
from siltstone.operators import ranges
from siltstone.plans.lineage import cut

D = C.DEFAULTS


def extracted(docs: DataFrame, doc_id: str, text: str, names: int = 10) -> DataFrame:
    """(doc_id, seq, name, norm_name): the first ``names`` names in order of sight, one of each normal form, capitalised before
    acronyms. The limit is a parameter; names beyond it are left out."""
    stop = F.array(*[F.lit(w) for w in C.CAPITALISED_STOPWORDS])
    found = F.filter(F.concat(T.all_found(F.col(text), T.CAPITALISED), T.all_found(F.col(text), T.ACRONYM)), lambda w: ~F.array_contains(stop, w))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.array_distinct(found)).alias("at", "name")).withColumn("norm_name", T.normal_name(F.col("name")))
    first = rows.where("norm_name <> ''").groupBy("doc_id", "norm_name").agg(F.min_by("name", "at").alias("name"), F.min("at").alias("at"))
    order = Window.partitionBy("doc_id").orderBy("at")
    return first.withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= names).select("doc_id", "seq", "name", "norm_name")


def co_mentions(entities: DataFrame, pairs: int = 8) -> DataFrame:
    """(doc_id, seq, source, predicate, target) of neighbouring names in each document."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    return (
        entities.withColumn("target", F.lead("norm_name").over(order))
        .where("target is not null and target <> norm_name")
        .where(F.col("seq") <= pairs)
        .select("doc_id", "seq", F.col("norm_name").alias("source"), F.lit("CO_MENTIONED_WITH").alias("predicate"), "target")
    )


def upsert_entities(rows: DataFrame, keys: tuple[str, ...] = ("norm_name",)) -> DataFrame:
    """One row an entity: first name, number of writes, first kind that isn't OTHER, first description that isn't empty."""
    at = F.struct("doc_id", "seq")
    kind = F.col("kind") if "kind" in rows.columns else F.lit("OTHER")
    note = F.col("description") if "description" in rows.columns else F.lit("")
    return rows.groupBy(*keys).agg(
        F.min_by("name", at).alias("name"),
        F.count(F.lit(1)).alias("mentions"),
        F.coalesce(F.min_by(F.when(kind != "OTHER", kind), F.when(kind != "OTHER", at)), F.lit("OTHER")).alias("kind"),
        F.coalesce(F.min_by(F.when(note != "", note), F.when(note != "", at)), F.lit("")).alias("description"),
    )


def upsert_relations(rows: DataFrame, keys: tuple[str, ...] = ("source", "predicate", "target")) -> DataFrame:
    """One row a directed relation: weight counts writes, first_doc and n_docs tell where from; blanks and loops are dropped."""
    ok = rows.where("coalesce(source, '') <> '' and coalesce(target, '') <> '' and source <> target")
    return ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("first_doc"), F.countDistinct("doc_id").alias("n_docs"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "weight").unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "weight"))


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree): edges at either end, parallel predicates each."""
    return both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def facets(rows: DataFrame, by: Column, cap: int | None = None) -> DataFrame:
    """(facet, n) by descending count, then name."""
    out = rows.groupBy(by.alias("facet")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "facet").limit(cap) if cap else out


def hub_cutoff(entities: DataFrame) -> DataFrame:
    """One row: cutoff, the 99th percentile of mentions, 10 at least."""
    return entities.agg(F.greatest(F.lit(float(D.hub_floor)), F.coalesce(F.percentile("mentions", D.hub_share), F.lit(0.0))).alias("cutoff"))


def hub_threshold(counts: Column) -> Column:
    """Of an array of mentions: eight times the upper median, 10 at least; infinite if empty."""
    ordered = F.sort_array(counts)
    median = F.element_at(ordered, (F.floor(F.size(counts) / 2) + 1).cast("int"))
    return F.when(F.size(counts) == 0, F.lit(float("inf"))).otherwise(F.greatest(F.lit(float(D.hub_floor)), (D.hub_multiple * median).cast("double")))


def hub_thresholds(counts: DataFrame, keys: list[str], mentions: str = "mentions") -> DataFrame:
    """(keys, hub_at): ``hub_threshold`` of each key's rows, without a list of them."""
    median = ranges.ranked(counts, keys, mentions, F.floor(F.col("n") / 2) + 1)
    return median.select(*keys, F.greatest(F.lit(float(D.hub_floor)), (D.hub_multiple * F.col(mentions)).cast("double")).alias("hub_at"))


def seeds(candidates: DataFrame, question: str) -> DataFrame:
    """(question, seq, norm_name, mentions) candidates -> those that tell the question from others.

    Near-duplicates and back-references go. Precise: named in the question, or sharing a word that fewer than three
    candidates share, and no hub. With two precise ones only those stay; else the vague ones follow; else the first two.
    """
    keys = Window.partitionBy("question_id")
    stop = F.array(*[F.lit(w) for w in C.QUESTION_STOPWORDS])
    asked = F.array_except(F.transform(T.all_found(F.col(question), r"[A-Za-z0-9][A-Za-z0-9_-]{2,}"), F.lower), stop)
    rows = candidates.withColumn("shared", F.array_intersect(F.array_distinct(F.split("norm_name", " ")), asked))
    common = rows.select("question_id", F.explode("shared").alias("token")).groupBy("question_id", "token").agg(F.count(F.lit(1)).alias("df")).where("df < 3")
    rare = common.groupBy("question_id").agg(F.collect_set("token").alias("rare"))
    rows = rows.join(rare, "question_id", "left").withColumn("hub_at", hub_threshold(F.collect_list(F.coalesce("mentions", F.lit(1))).over(keys)))
    squash = T.squashed(F.col("norm_name"))
    rows = rows.withColumn("squash", squash).withColumn("first", F.row_number().over(Window.partitionBy("question_id", "squash").orderBy("seq")))
    words = F.split("norm_name", " ")
    back = (F.size(words) >= 2) & F.element_at(words, 1).isin(*C.BACK_REFERENCES)
    kept = rows.where((F.col("squash") != "") & (F.col("first") == 1) & ~back)
    named = F.contains(F.lower(question), F.col("norm_name")) | F.arrays_overlap("shared", F.coalesce("rare", F.array().cast("array<string>")))
    kept = kept.withColumn("strong", F.coalesce(named, F.lit(False)) & (F.coalesce("mentions", F.lit(1)) < F.col("hub_at")))
    kept = kept.withColumn("n_strong", F.sum(F.col("strong").cast("int")).over(keys))
    chosen = kept.where("strong or n_strong < 2").select("question_id", "seq", "norm_name", "mentions", "strong")
    none = rows.join(chosen.select("question_id").distinct(), "question_id", "left_anti").withColumn("place", F.row_number().over(keys.orderBy("seq"))).where("place <= 2")
    return chosen.unionByName(none.select("question_id", "seq", "norm_name", "mentions", F.lit(False).alias("strong")))


def frontiers(edges: DataFrame, start: DataFrame, hops: int, passable: DataFrame | None = None) -> DataFrame:
    """(node, depth): smallest depth of each node within ``hops``. Beyond depth 0 only ``passable`` nodes go on."""
    ways = both_ways(edges).select("node", "other").distinct()
    seen = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, hops + 1):
        front = seen.where(F.col("depth") == depth - 1).select("node")
        if passable is not None and depth > 1:
            front = front.join(passable, "node", "left_semi")
        found = ways.join(front, "node", "left_semi").select(F.col("other").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = cut(seen.unionByName(found.withColumn("depth", F.lit(depth))))
    return seen


def khop_edges(edges: DataFrame, entities: DataFrame, start: DataFrame, hops: int = D.hops, cap: int | None = D.edge_cap) -> DataFrame:
    """Edges at frontier nodes of depth below ``hops``: seeds all, deeper ones only if no hub; edges between hubs go.

    ``entities`` is (node, mentions). The set equals that of all trails' edges, without enumerating trails.
    """
    cutoff = hub_cutoff(entities)
    marked = entities.crossJoin(F.broadcast(cutoff)).select("node", (F.col("mentions") >= F.col("cutoff")).alias("hub"))  # one row
    plain = marked.where("not hub").select("node")
    seen = frontiers(edges, start, max(1, min(3, hops)) - 1, plain)
    front = seen.where("depth = 0").select("node").unionByName(seen.where("depth > 0").join(plain, "node", "left_semi").select("node"))
    at = edges.join(front.withColumnRenamed("node", "source"), "source", "left_semi").unionByName(edges.join(front.withColumnRenamed("node", "target"), "target", "left_semi").select(*edges.columns)).distinct()
    hubs = marked.where("hub").select("node")
    ends = at.join(hubs.withColumnRenamed("node", "source").withColumn("s", F.lit(True)), "source", "left").join(hubs.withColumnRenamed("node", "target").withColumn("t", F.lit(True)), "target", "left")
    out = ends.where("s is null or t is null").select(*edges.columns)
    return out.orderBy(F.desc("weight"), "source", "predicate", "target").limit(cap) if cap else out


def induced(edges: DataFrame, nodes: DataFrame, cap: int | None = 600) -> DataFrame:
    """Edges with both ends among ``nodes``, heaviest first."""
    inside = edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi").select(*edges.columns)
    return inside.orderBy(F.desc("weight"), "source", "predicate", "target").limit(cap) if cap else inside


def overview(entities: DataFrame, edges: DataFrame, limit: int = 150) -> DataFrame:
    """Nodes of the highest degree, then mentions; one more than the limit tells that there are more."""
    ranked = entities.join(degree(edges), "node").orderBy(F.desc("degree"), F.desc("mentions"), "node").limit(limit + 1)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), F.desc("mentions"), "node"))).where(F.col("rank") <= limit)


def neighbours(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, strength) one hop from ``start``, without it."""
    near = both_ways(edges).join(start.select("node").distinct(), "node", "left_semi").groupBy(F.col("other").alias("node")).agg(F.sum(F.coalesce("weight", F.lit(1))).alias("strength"))
    return near.join(start.select("node"), "node", "left_anti")


def orphans(entities: DataFrame, mentions: DataFrame, key: str = "norm_name") -> DataFrame:
    return entities.join(mentions.select(key).distinct(), key, "left_anti")


def without_document(mentions: DataFrame, entities: DataFrame, edges: DataFrame, doc: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions, entities and edges after a document is deleted; entities that nothing mentions go with their edges."""
    rest = mentions.where(F.col("doc_id") != doc)
    left = entities.join(rest.select("norm_name").distinct(), "norm_name", "left_semi")
    names = left.select(F.col("norm_name").alias("node"))
    return rest, left, induced(edges, names, None)


def facts_text(edges: DataFrame, limit: int = 40) -> DataFrame:
    """One row: the heaviest relations as sentences under a heading."""
    sentence = F.concat_ws(" ", "source", F.replace(F.lower("predicate"), F.lit("_"), F.lit(" ")), F.concat("target", F.lit(".")))
    ranked = edges.orderBy(F.desc("weight"), "source", "predicate", "target").limit(limit)
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "source", "predicate", "target", sentence.alias("s")))), lambda r: F.concat(F.lit("- "), r["s"]))
    return ranked.agg(F.concat(F.lit("Knowledge graph facts:\n"), F.array_join(listed, "\n")).alias("facts"))
