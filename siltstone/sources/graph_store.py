"""A stored graph: entities and an adjacency table in buckets of nodes, with keyed merges and deletions by document.

Writes append what documents say (``Commits`` makes each visible as a whole): a mention of an entity, a relation under either of
its ends. Counts and weights are sums over what lives, so merging a document is an append, and deleting or replacing one is a
row in ``gone`` that ends its rows up to a generation. A traversal reads the buckets of its frontier only.

    mentions    (node, doc_id, seq, name, kind, description, n, gen), partitioned by bucket of node
    edges       (node, other, predicate, forward, doc_id, n, gen), partitioned by bucket of node; each relation stands twice
    gone        (doc_id, until, gen): rows of the document of generations up to ``until`` don't count
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import DEFAULTS as D
from siltstone.operators.retrieval import small
from siltstone.plans.lineage import cut
from siltstone.sources.commits import Commits


@dataclass(frozen=True)
class GraphStore:
    """``key`` is the type of nodes, ``doc`` that of document ids."""

    spark: SparkSession
    path: str
    key: str = "string"
    doc: str = "long"

    @property
    def commits(self) -> Commits:
        return Commits(self.spark, self.path)

    @staticmethod
    def create(spark: SparkSession, path: str, key: str = "string", doc: str = "long", buckets: int = 64) -> GraphStore:
        store = GraphStore(spark, path, key, doc)
        store.commits.publish(store.commits.manifest(0), {}, {"buckets": buckets, "cutoff": float(D.hub_floor), "entities": 0})
        return store

    def bucket(self, buckets: int):
        return F.pmod(F.xxhash64(F.col("node").cast(self.key)), F.lit(buckets)).cast("int")

    # ---- writes -----------------------------------------------------------------------------------------------------

    def upsert(self, mentions: DataFrame, relations: DataFrame, token: str | None = None, replace: bool = False) -> GraphStore:
        """Adds mentions (node, doc_id, seq, name, kind, description, n) and relations (source, predicate, target, doc_id, n).

        Blank nodes, loops and rows without a document are left out. With ``replace`` the documents' earlier rows no longer
        count, so a document that is read anew takes its own place. A write of a known token has been done.
        """
        base = self.commits.manifest()
        if token and token in base["tokens"]:
            return self
        version, buckets = base["version"] + 1, base["info"]["buckets"]
        named = lambda c: (F.col(c).cast(self.key) != F.lit("").cast(self.key)) if self.key == "string" else F.col(c).isNotNull()
        rows = mentions.where(named("node") & F.col("doc_id").isNotNull()).select(F.col("node").cast(self.key).alias("node"), F.col("doc_id").cast(self.doc).alias("doc_id"), "seq", "name", "kind", "description", F.col("n").cast("long").alias("n"))
        good = relations.where(named("source") & named("target") & (F.col("source") != F.col("target")) & F.col("doc_id").isNotNull())
        ends = [F.struct(F.col(a).cast(self.key).alias("node"), F.col(b).cast(self.key).alias("other"), F.lit(f).alias("forward")) for a, b, f in (("source", "target", True), ("target", "source", False))]
        sides = good.select(F.explode(F.array(*ends)).alias("x"), "predicate", F.col("doc_id").cast(self.doc).alias("doc_id"), F.col("n").cast("long").alias("n"))
        sides = sides.groupBy("x", "predicate", "doc_id").agg(F.sum("n").alias("n")).select("x.node", "x.other", "predicate", "x.forward", "doc_id", "n")
        added = {}
        for table, frame in (("mentions", rows), ("edges", sides)):
            added[table] = [self.commits.folder(table, version)]
            frame.withColumn("bucket", self.bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket", "node").write.partitionBy("bucket").parquet(added[table][0])
        if replace:
            docs = rows.select("doc_id").unionByName(good.select(F.col("doc_id").cast(self.doc).alias("doc_id"))).distinct()
            added["gone"] = [self._gone(docs, version, version - 1)]
        return self._publish(base, added, token)

    def delete(self, docs: DataFrame, token: str | None = None) -> GraphStore:
        """The documents (doc_id) say nothing any more; what only they mention goes with them."""
        base = self.commits.manifest()
        if token and token in base["tokens"]:
            return self
        version = base["version"] + 1
        return self._publish(base, {"gone": [self._gone(docs.select(F.col("doc_id").cast(self.doc).alias("doc_id")).distinct(), version, version)]}, token)

    def _gone(self, docs: DataFrame, version: int, until: int) -> str:
        path = self.commits.folder("gone", version)
        docs.withColumn("until", F.lit(until)).write.parquet(path)
        return path

    def _publish(self, base: dict, added: dict, token: str | None) -> GraphStore:
        """Takes the hub cutoff along, so that no traversal goes through all entities."""
        folders = {t: [*base["folders"].get(t, []), *(p.removeprefix(f"{self.path}/") for p in added.get(t, []))] for t in ("mentions", "edges", "gone")}
        counted = self.entities(manifest={**base, "folders": folders})
        n, cutoff = counted.agg(F.count(F.lit(1)), F.greatest(F.lit(float(D.hub_floor)), F.coalesce(F.percentile("mentions", D.hub_share), F.lit(0.0)))).first()
        self.commits.publish(base, added, base["info"] | {"entities": n, "cutoff": cutoff}, token)
        return self

    # ---- reads ------------------------------------------------------------------------------------------------------

    def _rows(self, table: str, schema: str, nodes: DataFrame | None, manifest: dict | None) -> DataFrame:
        """Living rows; with ``nodes`` only theirs, from their buckets."""
        manifest = manifest or self.commits.manifest()
        rows = self.commits.read(table, f"node {self.key}, {schema}, doc_id {self.doc}, n long, gen int, bucket int", manifest=manifest)
        if nodes is not None:
            which = [r[0] for r in nodes.select(self.bucket(manifest["info"]["buckets"])).distinct().collect()]  # as many as there are buckets
            rows = rows.where(F.col("bucket").isin(which)).join(small(nodes.select("node").distinct(), 200_000), "node", "left_semi")
        if not manifest["folders"].get("gone"):
            return rows
        gone = self.commits.read("gone", f"doc_id {self.doc}, until int, gen int", manifest=manifest).groupBy("doc_id").agg(F.max("until").alias("until"))
        return rows.join(small(gone, 200_000), "doc_id", "left").where("until is null or gen > until").drop("until")

    def entities(self, nodes: DataFrame | None = None, manifest: dict | None = None) -> DataFrame:
        """(node, mentions, name, kind, description): of all entities or of ``nodes``; first name, first kind that isn't OTHER, first
        description that isn't empty."""
        rows = self._rows("mentions", "seq long, name string, kind string, description string", nodes, manifest)
        at = F.struct("gen", "doc_id", "seq")
        first = lambda c, fits: F.min_by(F.when(fits, F.col(c)), F.when(fits, at))
        return rows.groupBy("node").agg(
            F.sum("n").alias("mentions"),
            F.min_by("name", at).alias("name"),
            F.coalesce(first("kind", F.col("kind") != "OTHER"), F.lit("OTHER")).alias("kind"),
            F.coalesce(first("description", F.col("description") != ""), F.lit("")).alias("description"),
        )

    def adjacent(self, nodes: DataFrame | None = None, manifest: dict | None = None) -> DataFrame:
        """(node, other, predicate, forward, weight, docs): the relations at ``nodes``, from their buckets."""
        rows = self._rows("edges", "other " + self.key + ", predicate string, forward boolean", nodes, manifest)
        return rows.groupBy("node", "other", "predicate", "forward").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("docs"))

    def edges(self, nodes: DataFrame | None = None, manifest: dict | None = None) -> DataFrame:
        """(source, predicate, target, weight) with an end among ``nodes``, each once."""
        rows = self.adjacent(nodes, manifest)
        ends = F.when(F.col("forward"), F.struct(F.col("node").alias("source"), F.col("other").alias("target"))).otherwise(F.struct(F.col("other").alias("source"), F.col("node").alias("target")))
        return rows.where("forward" if nodes is None else "true").select(ends.alias("x"), "predicate", "weight").distinct().select("x.source", "predicate", "x.target", "weight")

    def khop(self, start: DataFrame, hops: int = D.hops, cap: int | None = D.edge_cap) -> DataFrame:
        """``graph.khop_edges`` from the store: each hop reads the buckets of its frontier."""
        manifest = self.commits.manifest()
        cutoff, found, seen = manifest["info"]["cutoff"], None, None
        front = cut(start.select("node").distinct())
        for depth in range(max(1, min(3, hops))):
            at = cut(self.adjacent(front, manifest))
            found = at if found is None else found.unionByName(at)
            seen = front if seen is None else cut(seen.unionByName(front))
            if depth + 1 < max(1, min(3, hops)):
                near = at.select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti")
                plain = self.entities(near, manifest).where(F.col("mentions") < cutoff).select("node")
                front = cut(plain)
        ends = found.select(F.explode(F.array("node", "other")).alias("node")).distinct()
        hubs = cut(self.entities(ends, manifest).where(F.col("mentions") >= cutoff).select("node", F.lit(True).alias("hub")))
        mark = lambda df, c: df.join(hubs.select(F.col("node").alias(c), F.col("hub").alias("hub_" + c)), c, "left")
        rows = mark(mark(found, "node"), "other").where("hub_node is null or hub_other is null")
        ends = F.when(F.col("forward"), F.struct(F.col("node").alias("source"), F.col("other").alias("target"))).otherwise(F.struct(F.col("other").alias("source"), F.col("node").alias("target")))
        out = rows.select(ends.alias("x"), "predicate", "weight").distinct().select("x.source", "x.target", "predicate", "weight")
        return out.orderBy(F.desc("weight"), "source", "predicate", "target").limit(cap) if cap else out

    def compact(self) -> GraphStore:
        """What lives as one generation, without the rows of documents that are gone."""
        base = self.commits.manifest()
        version, added = base["version"] + 1, {}
        for table, schema in (("mentions", "seq long, name string, kind string, description string"), ("edges", f"other {self.key}, predicate string, forward boolean")):
            added[table] = [self.commits.folder(table, version)]
            self._rows(table, schema, None, base).drop("gen").repartition("bucket").sortWithinPartitions("bucket", "node").write.partitionBy("bucket").parquet(added[table][0])
        self.commits.publish(base, added, base["info"], None, replace=True)
        return self


def written(store: GraphStore, found: DataFrame, pairs: DataFrame, token: str | None = None, replace: bool = True) -> GraphStore:
    """Writes what ``graph.extracted`` and ``graph.co_mentions`` found in documents."""
    kinds = {c: F.col(c) if c in found.columns else F.lit(v) for c, v in (("kind", "OTHER"), ("description", ""))}
    mentions = found.select(F.col("norm_name").alias("node"), "doc_id", F.col("seq").cast("long").alias("seq"), "name", kinds["kind"].alias("kind"), kinds["description"].alias("description"), F.lit(1).alias("n"))
    return store.upsert(mentions, pairs.select("source", "predicate", "target", "doc_id", F.lit(1).alias("n")), token, replace)


def rebuilt(store: GraphStore) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) as ``graph.upsert_entities`` and ``graph.upsert_relations`` name them."""
    relations = store.adjacent().where("forward").select(F.col("node").alias("source"), "predicate", F.col("other").alias("target"), "weight", F.col("docs").alias("n_docs"))
    return store.entities().withColumnRenamed("node", "norm_name"), relations


