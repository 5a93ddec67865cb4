"""The explorer's views of a stored graph: entity and relation lists, entity details, bounded neighbourhoods, merged views.

Entities are (id, name, norm_name, kind, description, mentions), relations (source, predicate, target, weight, description),
mentions (id, chunk_id, n) of chunks (chunk_id, doc_id, filename, page_no).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import config as C
from siltstone.functions import text as T
from siltstone.operators import graph
from siltstone.plans.lineage import cut


def blank_as(value: Column, default) -> Column:
    return F.coalesce(F.when(F.trim(value.cast("string")) != "", value), F.lit(default))


def entity_rows(entities: DataFrame) -> DataFrame:
    """Entities with defaults: kind OTHER, the id as name, null for an empty description."""
    note = F.when(F.trim("description") != "", F.col("description"))
    return entities.select("id", blank_as(F.col("name"), None).alias("n0"), "norm_name", blank_as(F.col("kind"), "OTHER").alias("kind"), note.alias("description"), F.coalesce("mentions", F.lit(0)).alias("mentions")).withColumn("name", F.coalesce("n0", F.col("id").cast("string"))).drop("n0")


def relation_rows(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with both ends' names and kinds, and defaults: predicate RELATED_TO, weight 1."""
    e = entity_rows(entities)
    end = lambda c: e.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"), F.col("norm_name").alias(f"{c}_norm"), F.col("kind").alias(f"{c}_kind"))
    rows = relations.withColumn("predicate", blank_as(F.col("predicate"), "RELATED_TO")).withColumn("weight", F.coalesce("weight", F.lit(1)))
    return rows.join(end("source"), "source").join(end("target"), "target")


def search_terms(q: Column) -> tuple[Column, Column]:
    """(as a name, as it is), lower-cased; null for blank questions."""
    low = F.lower(F.trim(q))
    asked = F.when(low != "", low)
    return F.when(asked.isNotNull(), blank_as(T.normal_name(q), None)), asked


SORTS = {"degree": ("degree", "mentions"), "mentions": ("mentions", "degree"), "name": ()}


def listed_entities(entities: DataFrame, relations: DataFrame, q: str | None = None, kind: str | None = None, sort: str = "degree", limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(a page of entities with their degree, one row with the total). An unknown sort key counts as degree."""
    rows = entity_rows(entities).join(graph.degree(relations).withColumnRenamed("node", "id"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    name, low = search_terms(F.lit(q))
    if q and q.strip():
        rows = rows.where(F.contains("norm_name", F.coalesce(name, low)) | F.contains(F.lower("name"), low))
    if kind:
        rows = rows.where(F.col("kind") == kind)
    keys = [F.desc(c) for c in SORTS.get(sort, SORTS["degree"])] + [F.col("name"), F.col("id")]
    return rows.orderBy(*keys).offset(max(0, offset)).limit(max(1, min(100, limit))), rows.agg(F.count(F.lit(1)).alias("total"))


def listed_relations(relations: DataFrame, entities: DataFrame, q: str | None = None, predicate: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(a page of relations, one row with the total): of the predicate, and with the text in an end's name or the predicate."""
    rows = relation_rows(relations, entities)
    if predicate:
        rows = rows.where(F.col("predicate") == predicate)
    if q and q.strip():
        name, low = search_terms(F.lit(q))
        name = F.coalesce(name, low)
        rows = rows.where(F.contains("source_norm", name) | F.contains("target_norm", name) | F.contains(F.lower("predicate"), F.replace(low, F.lit(" "), F.lit("_"))))
    order = [F.desc("weight"), "source_name", "predicate", "target_name", "source", "target"]
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(100, limit))), rows.agg(F.count(F.lit(1)).alias("total"))


def mention_list(mentions: DataFrame, chunks: DataFrame, cap: int = 50) -> DataFrame:
    """(id, rank, chunk_id, filename, page_no, n): each entity's chunks by falling count, then file and page."""
    rows = mentions.join(chunks.select("chunk_id", "filename", "page_no"), "chunk_id")
    order = Window.partitionBy("id").orderBy(F.desc("n"), "filename", F.asc_nulls_first("page_no"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select("id", "rank", "chunk_id", "filename", "page_no", "n")


def details(wanted: DataFrame, entities: DataFrame, relations: DataFrame, mentions: DataFrame, chunks: DataFrame, cap: int = 200) -> DataFrame:
    """One row for each wanted id that exists: the entity with its outgoing and incoming relations (heaviest first, ``cap`` of
    each) and its mentions."""
    wanted = wanted.select("id").distinct()
    rel = relation_rows(relations, entities)

    def side(own: str, other: str, name: str) -> DataFrame:
        order = Window.partitionBy(own).orderBy(F.desc("weight"), "predicate", f"{other}_name", other)
        rows = rel.join(wanted.withColumnRenamed("id", own), own, "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)
        return rows.groupBy(F.col(own).alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "predicate", F.col(other).alias("other"), F.col(f"{other}_name").alias("name"), "weight"))).alias(name))

    seen = mention_list(mentions.join(wanted, "id", "left_semi"), chunks).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "filename", "page_no", "n"))).alias("mentioned_in"))
    out = entity_rows(entities).join(wanted, "id", "left_semi")
    for part in (side("source", "target", "outgoing"), side("target", "source", "incoming"), seen):
        out = out.join(part, "id", "left")
    return out


def stats(entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: entities, relations, chunks; zero where there are none."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(entities, "entities").crossJoin(F.broadcast(count(relations, "relations"))).crossJoin(F.broadcast(count(chunks, "chunks")))  # one row each


def neighbourhood(edges: DataFrame, entities: DataFrame, start: DataFrame, depth: int = 2, budget: int = 150) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth and rank of entry, edges among them): each depth takes the strongest new neighbours first, by summed
    weight, then mentions, as long as the budget lasts. The nodes' column ``truncated`` tells whether any was left out."""
    ways = graph.both_ways(edges)
    seen = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    cropped, left = False, budget - seen.count()
    for d in range(1, max(1, depth) + 1):
        front = seen.where(F.col("depth") == d - 1).select("node")
        near = ways.join(front, "node", "left_semi").groupBy(F.col("other").alias("node")).agg(F.sum(F.coalesce("weight", F.lit(1))).alias("strength"))
        new = near.join(seen.select("node"), "node", "left_anti").join(entities.select("node", "mentions"), "node", "left")
        # one more than fits tells that there are more
        best = cut(new.orderBy(F.desc("strength"), F.desc(F.coalesce("mentions", F.lit(0))), "node").limit(max(0, left) + 1))
        n = best.count()
        cropped = cropped or n > max(0, left)
        kept = best.orderBy(F.desc("strength"), F.desc(F.coalesce("mentions", F.lit(0))), "node").limit(max(0, left))
        seen = cut(seen.unionByName(kept.select("node").withColumn("depth", F.lit(d))))
        left -= min(n, max(0, left))
        if not n:
            break
    return seen.withColumn("truncated", F.lit(cropped)), graph.induced(edges, seen)


def merged_views(old: DataFrame, new: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """Rows of two views of one graph by key: of nodes the old ones stay (keep 'old'), of edges the new ones (keep 'new')."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "__age")]
    pick = F.min_by if keep == "old" else F.max_by
    chosen = pick(F.struct(*rest), F.col("__age")) if rest else F.lit(None)
    return both.groupBy(*keys).agg(chosen.alias("__row")).select(*keys, *([F.col("__row")[c].alias(c) for c in rest]))


# ---- a model's extractions ------------------------------------------------------------------------------------------

PAYLOAD = "struct<entities:array<struct<name:string,type:string,description:string>>,relations:array<struct<source:string,predicate:string,target:string,description:string>>>"


def normalised(payload: Column, most: int = 12) -> Column:
    """struct(entities, relations) of a model's JSON: at most ``most`` of each; names up to 120 characters, unknown kinds OTHER;
    predicates in capitals, digits and _; relations only between declared names, none to itself."""
    raw = F.from_json(payload, PAYLOAD)
    kinds = F.array(*[F.lit(k) for k in C.ENTITY_KINDS])
    kind = lambda e: F.upper(F.trim(F.coalesce(e["type"], F.lit(""))))
    named = F.filter(F.coalesce(raw["entities"], F.array()), lambda e: F.trim(F.coalesce(e["name"], F.lit(""))) != "")
    entities = F.transform(
        F.slice(named, 1, most),
        lambda e: F.struct(
            F.substring(F.trim(e["name"]), 1, 120).alias("name"),
            F.when(F.array_contains(kinds, kind(e)), kind(e)).otherwise("OTHER").alias("kind"),
            F.coalesce(F.trim(e["description"]), F.lit("")).alias("description"),
        ),
    )
    known = F.transform(entities, lambda e: e["name"])
    end = lambda r, c: F.substring(F.trim(F.coalesce(r[c], F.lit(""))), 1, 120)
    fit = F.filter(F.coalesce(raw["relations"], F.array()), lambda r: F.array_contains(known, end(r, "source")) & F.array_contains(known, end(r, "target")) & (end(r, "source") != end(r, "target")))
    word = lambda r: F.regexp_replace(F.regexp_replace(F.upper(F.trim(F.coalesce(r["predicate"], F.lit("")))), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    relations = F.transform(
        F.slice(fit, 1, most),
        lambda r: F.struct(end(r, "source").alias("source"), F.coalesce(F.when(word(r) != "", F.substring(word(r), 1, 60)), F.lit("RELATED_TO")).alias("predicate"), end(r, "target").alias("target"), F.coalesce(F.trim(r["description"]), F.lit("")).alias("description")),
    )
    return F.struct(entities.alias("entities"), relations.alias("relations"))


def extracted_by(chunks: DataFrame, model, mode: str = "selective", chars: int = 6000) -> DataFrame:
    """(chunk_id, entities, relations): ``model`` turns a column of texts into one of JSON. Each distinct text is asked once;
    where the model gives null, and where it finds nothing in mode 'on', capitalised names and acronyms stand in."""
    fit = chunks.where(T.worth_extracting(F.col("text"), mode)).select("chunk_id", F.substring("text", 1, chars).alias("text"))
    asked = fit.select("text").distinct().withColumn("answer", model(F.col("text")))
    asked = cut(asked.withColumn("x", F.when(F.col("answer").isNotNull(), normalised(F.col("answer")))))
    rows = fit.join(asked, "text", "left")
    none = F.col("x").isNull() | (F.lit(mode == "on") & (F.size("x.entities") == 0))
    heads = F.transform(F.slice(T.names_in(F.col("text")), 1, 10), lambda n: F.struct(n.alias("name"), F.lit("OTHER").alias("kind"), F.lit("").alias("description")))
    empty = F.array().cast("array<struct<source:string,predicate:string,target:string,description:string>>")
    return rows.select("chunk_id", F.when(none, heads).otherwise(F.col("x.entities")).alias("entities"), F.when(none, empty).otherwise(F.col("x.relations")).alias("relations"))
