"""A persisted index of chunks: BM25 postings in blocks with their largest impact, and vectors; with upserts, deletions, counts and
a guard.

Writes append a generation by ``Commits``, so that each is visible as a whole or not at all and can be repeated. Of a chunk the
newest generation counts; a deletion is a generation in which the chunk has no length. ``compact`` writes the living rows as one
generation. The manifest carries the number of chunks and words, so that no search counts them.

    postings    (term, block, posts, impact), partitioned by bucket; a block has the postings of next lower impact of those that a
                task ordered at once, 16 bytes each (POST), as Spark takes long to read arrays
    terms       (term, df, tops), partitioned by bucket, a row for each block or more of a term: df adds up, and the largest of
                all tops bound the term's impacts
    lengths     (chunk_id, gen, dl), dl null where the generation deletes the chunk
    vectors     (chunk_id, gen, embedding)

``top`` searches by MaxScore: the k-th largest impact of one of a question's terms is a score that k chunks reach, so blocks whose
impact with the most that the other terms can give stays below it aren't read, and chunks that only have terms which together
stay below it aren't scored. It goes by one generation's exact statistics; an index of several is searched whole. Postings are
read and sent once, however many questions ask for them: they are dealt by chunk, and each part of the chunks adds up the scores of
all questions in arrays and sends on the best.

Texts are cut into terms by Arrow workers, which send a term's postings of many chunks as one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.config import DEFAULTS
from siltstone.operators import retrieval as R
from siltstone.plans.lineage import cut
from siltstone.sources.commits import Commits

ANALYZER = "lower [a-z0-9]+"
BLOCK = 128  # postings of a block
SLICE = 1 << 20  # postings that a task holds and orders at once
WORDS = 1 << 22  # words of texts that a task holds at once
PART = 16_384  # chunks whose scores are added up at once
TOPS = 64  # impacts kept of a term; searches for more than that aren't pruned
DRIVER_TERMS = 20_000  # terms of a batch of questions that are looked up by value

#: Lower-cases ASCII letters, keeps digits, and ends terms at all other bytes; the same with all letters and digits as one.
ENDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SHAPE = bytes(97 if b != 32 else 32 for b in ENDS)
#: Beyond ASCII, what has an ASCII letter in lower case: the Kelvin sign and I with a dot.
LETTERS = ("\u212a".encode(), "\u0130".encode())
#: A posting; tf is negative where the chunk's id is null. Then one of a search.
POST = np.dtype([("id", "<i8"), ("tf", "<i4"), ("dl", "<i4")])
FOUND = np.dtype([*POST.descr, ("term", "<i4")])

POSTINGS = "term string, block int, posts binary, impact double, gen int, bucket int"
LAYOUT = 2


def saturation(tf, dl, mean: float, k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(mean)))


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str

    @property
    def commits(self) -> Commits:
        return Commits(self.spark, self.path)

    @staticmethod
    def create(spark: SparkSession, path: str, dim: int, buckets: int = 32) -> Index:
        index = Index(spark, path)
        info = {"dim": dim, "buckets": buckets, "analyzer": ANALYZER, "layout": LAYOUT, "chunks": 0, "words": 0, "gens": 0}
        index.commits.publish(index.commits.manifest(0), {}, info)
        return index

    def manifest(self) -> dict:
        """The guard: an index of another analyzer or layout isn't opened."""
        now = self.commits.manifest()
        if now["info"].get("analyzer") != ANALYZER or now["info"].get("layout") != LAYOUT:
            raise ValueError(f"no compatible index at {self.path}; build it anew")
        return now

    def meta(self) -> dict:
        return self.manifest()["info"]

    def lengths(self, manifest: dict | None = None) -> DataFrame:
        """(chunk_id, gen, dl) of the living chunks."""
        manifest = manifest or self.manifest()
        rows = self.commits.read("lengths", "chunk_id long, dl int, gen int", manifest=manifest)
        if manifest["info"]["gens"] <= 1:
            return rows.select("chunk_id", "gen", "dl").where("dl is not null")
        newest = rows.groupBy("chunk_id").agg(F.max_by(F.struct("gen", "dl"), "gen").alias("x"))
        return newest.select("chunk_id", "x.gen", "x.dl").where("dl is not null")

    def _publish(self, base: dict, added: dict[str, list[str]], token: str | None, replace: bool = False) -> None:
        """Counts what lives after the write and makes it visible."""
        folders = {} if replace else dict(base["folders"])
        next_ = {"version": base["version"] + 1, "info": base["info"] | {"gens": 1 if replace else base["info"]["gens"] + 1}}
        next_["folders"] = folders | {"lengths": [*folders.get("lengths", []), *(p.removeprefix(f"{self.path}/") for p in added.get("lengths", []))]}
        n, words = self.lengths(next_).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        self.commits.publish(base, added, next_["info"] | {"chunks": n, "words": words}, token, replace)

    def upsert(self, chunks: DataFrame, text: str = "text", vector: str | None = None, token: str | None = None, vectors: DataFrame | None = None) -> Index:
        """Chunks (chunk_id, text[, vector]) replace those of their ids; of rows that repeat an id the greatest text counts.
        Vectors can stand in a table of their own, ``vectors`` (chunk_id, embedding): those of the chunks are taken. Vectors of another dimension stop the write before anything is written; a write of a known token has been done."""
        base = self.manifest()
        if token and token in base["tokens"]:
            return self
        if vectors is None and vector is not None:
            vectors = chunks.select("chunk_id", F.col(vector).alias("embedding"))
        if vectors is not None and vectors.where(F.size("embedding") != base["info"]["dim"]).limit(1).count():
            raise ValueError(f"vectors of another dimension than {base['info']['dim']}")
        keyed = F.col("chunk_id").cast("long").alias("chunk_id")
        rows = chunks.select(keyed, F.coalesce(F.col(text), F.lit("")).alias("text"))
        again = rows.groupBy(F.col("chunk_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
        if repeated := again.limit(1).count():  # else no text has to meet another
            same = F.col("chunk_id").eqNullSafe(F.col("id"))
            rows = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").groupBy("chunk_id").agg(F.max("text").alias("text")))
        added = {"lengths": [self._write(rows.mapInArrow(counted_terms, "chunk_id long, dl int"), "lengths", base)]}
        written = self.spark.read.schema("chunk_id long, dl int").parquet(added["lengths"][0])
        mean = written.agg(F.coalesce(F.avg("dl"), F.lit(1.0))).first()[0]
        added |= self._postings(rows.mapInArrow(listed_terms(WORDS), "term string, posts binary"), mean, base)
        if vectors is not None:
            own = vectors.select(keyed, F.col("embedding").cast("array<float>").alias("embedding"))
            if vector is not None and repeated:  # the vector that stands with the greatest text
                beside = chunks.select(keyed, F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(vector).cast("array<float>").alias("embedding"))
                own = beside.groupBy("chunk_id").agg(F.max(F.struct("text", "embedding")).alias("x")).select("chunk_id", "x.embedding")
            elif vector is None:
                own = own.groupBy("chunk_id").agg(F.max("embedding").alias("embedding")).join(written.select("chunk_id"), "chunk_id", "left_semi")
            added["vectors"] = [self._write(own if vector is not None else own.where("embedding is not null"), "vectors", base)]
        self._publish(base, added, token)
        return self

    def _write(self, rows: DataFrame, table: str, base: dict, *by: str) -> str:
        path = self.commits.folder(table, base["version"] + 1)
        (rows.write.partitionBy(*by) if by else rows.write).option("compression", "zstd").parquet(path)
        return path

    def _postings(self, parts: DataFrame, mean: float, base: dict) -> dict[str, list[str]]:
        """Blocks by falling impact, and the terms' largest impacts, from (term, posts)."""
        dealt = parts.withColumn("bucket", self.bucket(base["info"]["buckets"])).repartition("bucket")
        blocks = dealt.mapInArrow(in_impact_order(max(mean, 1e-9), BLOCK, SLICE), POSTINGS.replace(" gen int,", ""))
        post = self._write(blocks.sortWithinPartitions("bucket", "term", "block"), "postings", base, "bucket")
        stored = self.spark.read.schema(POSTINGS.replace(" gen int,", "")).parquet(post)
        heads = stored.select("term", "block", "posts", "bucket").mapInArrow(largest(max(mean, 1e-9), BLOCK), "term string, df long, tops array<double>, bucket int")
        return {"postings": [post], "terms": [self._write(heads, "terms", base, "bucket")]}

    def delete(self, ids: DataFrame, token: str | None = None) -> Index:
        """The chunks with the given chunk_ids go."""
        base = self.manifest()
        if token and token in base["tokens"]:
            return self
        gone = ids.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lit(None).cast("int").alias("dl")).distinct()
        self._publish(base, {"lengths": [self._write(gone, "lengths", base)]}, token)
        return self

    def count(self) -> int:
        return self.meta()["chunks"]

    def compact(self) -> Index:
        """The living rows as one generation; older versions stay readable until ``Commits.vacuum``."""
        base = self.manifest()
        live = self.lengths(base)
        added = {"lengths": [self._write(live.select("chunk_id", "dl"), "lengths", base)]}
        parts = self.blocks(base).select("term", "posts")
        if base["info"]["gens"] > 1:
            rows = self.postings(base).join(live.select("chunk_id", "gen"), ["chunk_id", "gen"], "left_semi")
            parts = rows.select("term", "chunk_id", "tf", "dl").mapInArrow(packed, "term string, posts binary")
        mean = base["info"]["words"] / max(1, base["info"]["chunks"])
        added |= self._postings(parts, mean, base)
        added["vectors"] = [self._write(self.vectors(base), "vectors", base)]
        self._publish(base, added, None, replace=True)
        return self

    def blocks(self, manifest: dict | None = None) -> DataFrame:
        return self.commits.read("postings", POSTINGS, manifest=manifest or self.manifest())

    def postings(self, manifest: dict | None = None) -> DataFrame:
        """(term, chunk_id, tf, dl, gen, bucket), of replaced and deleted chunks too."""
        return each(self.blocks(manifest), "gen", "bucket")

    def vectors(self, manifest: dict | None = None) -> DataFrame:
        """(chunk_id, embedding) of the living chunks."""
        manifest = manifest or self.manifest()
        rows = self.commits.read("vectors", "chunk_id long, embedding array<float>, gen int", manifest=manifest)
        if manifest["info"]["gens"] <= 1:
            return rows.select("chunk_id", "embedding")
        return rows.join(self.lengths(manifest).select("chunk_id", "gen"), ["chunk_id", "gen"], "left_semi").select("chunk_id", "embedding")

    @staticmethod
    def bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")

    def bm25(self, queries: DataFrame, query_id: str = "query_id", query: str = "question", k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b) -> DataFrame:
        """(query_id, chunk_id, score), as ``retrieval.bm25`` has them, of every chunk that has a term of the question."""
        now = self.manifest()
        info = now["info"]
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(R.terms(F.col(query)))).alias("term"))
        n, which = asked.agg(F.count(F.lit(1)), F.collect_set(self.bucket(info["buckets"]))).first()  # as many numbers as there are buckets
        asked = F.broadcast(asked) if n <= R.BROADCAST_QUERIES * 20 else asked
        found = self.blocks(now).where(F.col("bucket").isin(which)).join(asked.select("term").distinct(), "term", "left_semi")
        found = each(found, "gen")
        if info["gens"] > 1:
            found = found.join(self.lengths(now).select("chunk_id", "gen"), ["chunk_id", "gen"], "left_semi")
        df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # no more rows than the queries have terms
        df = F.broadcast(df) if n <= R.BROADCAST_QUERIES * 20 else df
        idf = F.log(1 + (F.lit(info["chunks"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * saturation(F.col("tf"), F.col("dl"), self.mean(info), k1, b)
        return found.join(df, "term").select("chunk_id", "term", part.alias("part")).join(asked, "term").groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))

    @staticmethod
    def mean(info: dict) -> float:
        return max(info["words"], 1e-9) / max(1, info["chunks"])

    def plan(self, queries: DataFrame, k: int, query_id: str = "query_id", query: str = "question"):
        """(rows (query_id, term, idf, least, essential), of each term the buckets and least impact it has to be read to, the
        manifest) of a search for k chunks; None where it has to go through all postings."""
        now = self.manifest()
        info = now["info"]
        if info["gens"] != 1 or k > TOPS:
            return None
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(R.terms(F.col(query)))).alias("term")).withColumn("bucket", self.bucket(info["buckets"])).limit(DRIVER_TERMS + 1).collect()
        if len(asked) > DRIVER_TERMS:
            return None
        terms = sorted({r.term for r in asked})
        heads = self.commits.read("terms", "term string, df long, tops array<double>, bucket int", manifest=now)
        heads = heads.where(F.col("bucket").isin(sorted({r.bucket for r in asked})) & F.col("term").isin(terms))
        tops = F.slice(F.sort_array(F.flatten(F.collect_list("tops")), False), 1, TOPS)
        heads = {r.term: r for r in heads.groupBy("term", "bucket").agg(F.sum("df").alias("df"), tops.alias("tops")).collect()} if terms else {}
        idf = {t: log(1 + (info["chunks"] - h.df + 0.5) / (h.df + 0.5)) for t, h in heads.items()}
        most = {t: idf[t] * h.tops[0] for t, h in heads.items()}
        of: dict = {}
        for r in asked:
            if r.term in heads:
                of.setdefault(r.query_id, []).append(r.term)
        rows, reads = [], {}
        for q, own in of.items():
            reached = max((idf[t] * heads[t].tops[k - 1] for t in own if len(heads[t].tops) >= k), default=0.0) - 1e-6
            every, below = sum(most[t] for t in own), 0.0
            for t in sorted(own, key=most.__getitem__):
                below += most[t]
                least = (reached - (every - most[t])) / idf[t]
                rows.append((q, t, idf[t], least, below >= reached))
                reads[t] = min(reads.get(t, least), least)
        return rows, {t: (heads[t].bucket, least) for t, least in reads.items()}, now

    def top(self, queries: DataFrame, k: int = DEFAULTS.top_k) -> DataFrame:
        """(query_id, chunk_id, score, rank): the k best chunks of each question, by score to six places, then chunk."""
        planned = self.plan(queries, k)
        if planned is None:
            return R.top_k(self.bm25(queries).withColumn("score", F.round("score", 6)), "chunk_id", k)
        rows, reads, now = planned
        kind = queries.select("query_id").schema[0].dataType
        term_at, of = {t: i for i, t in enumerate(reads)}, {}
        weights = np.zeros(len(reads))
        for q, t, idf, _, _ in rows:
            of.setdefault(q, []).append(term_at[t])
            weights[term_at[t]] = idf
        shared = self.spark.sparkContext.broadcast((term_at, weights, [np.array(own) for own in of.values()]))  # DRIVER_TERMS at most
        parts = max(1, -(-now["info"]["chunks"] // PART))
        dealt = self.read_blocks(reads, now).select("term", "posts").mapInArrow(dealt_by_chunk(shared, parts), "part int, posts binary")
        best = dealt.groupBy("part").applyInArrow(best_of_part(shared, k, self.mean(now["info"])), "q int, chunk_id long, score double")
        asked = self.spark.createDataFrame([(i, q) for i, q in enumerate(of)], f"q int, query_id {kind.simpleString()}")
        return R.top_k(best.join(F.broadcast(asked), "q").select("query_id", "chunk_id", F.round("score", 6).alias("score")), "chunk_id", k)

    def read_blocks(self, reads: dict, now: dict) -> DataFrame:
        """The blocks of the terms, down to each term's least impact."""
        rows = self.blocks(now)
        buckets = sorted({b for b, _ in reads.values()})
        if len(reads) <= 500:  # written as conditions, they reach the files' row groups
            hit = F.lit(False)
            for t, (_, least) in reads.items():
                hit = hit | ((F.col("term") == t) & (F.col("impact") >= least))
            return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(reads)) & hit)
        wanted = self.spark.createDataFrame([(t, least) for t, (_, least) in reads.items()], "term string, down double")
        return rows.where(F.col("bucket").isin(buckets)).join(F.broadcast(wanted), "term").where("impact >= down").drop("down")

    def share_read(self, queries: DataFrame, k: int = DEFAULTS.top_k) -> tuple[int, int]:
        """(blocks that ``top`` reads, blocks of the questions' terms)."""
        planned = self.plan(queries, k)
        if planned is None:
            return (0, 0)
        _, reads, now = planned
        every = {t: (b, float("-inf")) for t, (b, _) in reads.items()}
        return self.read_blocks(reads, now).count(), self.read_blocks(every, now).count()

    def dense(self, queries: DataFrame, k: int = DEFAULTS.top_k) -> DataFrame:
        """(query_id, chunk_id, score, rank) of queries (query_id, query_vector): the k nearest living vectors; a chunk meets itself
        too."""
        return R.dense_top(self.vectors().withColumnRenamed("chunk_id", "item"), queries, k).withColumnRenamed("item", "chunk_id")

    def hybrid(self, queries: DataFrame, k: int = DEFAULTS.top_k) -> DataFrame:
        """(query_id, chunk_id, score, rank) of queries (query_id, question, query_vector): both branches over the same chunks."""
        branch = R.over_fetch(k)
        return R.fused(cut(self.dense(queries, branch)), cut(self.top(queries, branch)), "chunk_id", k)


def each(blocks: DataFrame, *keep: str) -> DataFrame:
    """(term, chunk_id, tf, dl, ...) from blocks of postings."""

    def run(batches):
        for batch in batches:
            rows, sizes = from_bytes(batch.column(1), POST)
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            own = [batch.column(0).take(at), pa.array(rows["id"], mask=rows["tf"] < 0), pa.array(np.abs(rows["tf"])), pa.array(rows["dl"].copy())]
            yield pa.record_batch([*own, *[batch.column(2 + i).take(at) for i in range(len(keep))]], ["term", "chunk_id", "tf", "dl", *keep])

    kinds = dict(blocks.dtypes)
    return blocks.select("term", "posts", *keep).mapInArrow(run, ", ".join(["term string, chunk_id long, tf int, dl int", *[f"{c} {kinds[c]}" for c in keep]]))


def lowered(text: bytes) -> bytes:
    return text.decode().lower().encode() if any(x in text for x in LETTERS) else text


def counted_terms(batches):
    """(chunk_id, dl) of (chunk_id, text): ``retrieval.terms`` begin where a letter or digit follows none."""
    for batch in batches:
        shapes = (lowered(x).translate(SHAPE) for x in batch.column(1).cast(pa.binary()).to_pylist())
        sizes = [x.count(b" a") + x.startswith(b"a") for x in shapes]
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int32())], ["chunk_id", "dl"])


class Numbers(dict):
    """Numbers of what is asked for, in the order of first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def as_bytes(rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The rows from each start to the next one as a value of bytes."""
    offsets = np.append(starts, len(rows)) * rows.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def from_bytes(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(rows, how many each value has) of ``as_bytes``."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // kind.itemsize
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    rows = np.frombuffer(column.buffers()[2], np.uint8)[first : first + int(sizes.sum()) * kind.itemsize] if sizes.sum() else np.zeros(0, np.uint8)
    return rows.view(kind), sizes


def listed_terms(most: int):
    """A function from (chunk_id, text) to (term, posts): the postings of ``most`` words at a time, a row for each of their terms."""

    def sent(numbers: Numbers, codes: list, ids: list) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in codes])
        met = np.sort((np.concatenate(codes).astype(np.int64) << 32) | np.repeat(np.arange(len(codes)), sizes))
        first = np.flatnonzero(np.r_[True, np.diff(met) != 0])
        code, doc = met[first] >> 32, met[first] & 0xFFFFFFFF
        rows = np.zeros(len(first), POST)
        rows["id"], rows["dl"] = np.array([i or 0 for i in ids], np.int64)[doc], sizes[doc]
        rows["tf"] = np.diff(np.r_[first, len(met)]) * np.array([-1 if i is None else 1 for i in ids])[doc]
        starts = np.flatnonzero(np.r_[True, np.diff(code) != 0])  # each number stands in a text
        return pa.record_batch([pa.array(list(numbers), pa.binary()).cast(pa.string()), as_bytes(rows, starts)], ["term", "posts"])

    def run(batches):
        numbers, codes, ids, n = Numbers(), [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                terms = lowered(text).translate(ENDS).split()
                if not terms:
                    continue
                codes.append(np.fromiter(map(numbers.__getitem__, terms), np.int32, len(terms)))
                ids.append(i)
                n += len(terms)
                if n >= most:
                    yield sent(numbers, codes, ids)
                    numbers, codes, ids, n = Numbers(), [], [], 0
        if codes:
            yield sent(numbers, codes, ids)

    return run


def packed(batches):
    """(term, posts) of (term, chunk_id, tf, dl)."""
    for batch in batches:
        rows = np.zeros(batch.num_rows, POST)
        nulls = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        rows["id"], rows["dl"] = batch.column(1).fill_null(0).to_numpy(), batch.column(3).to_numpy()
        rows["tf"] = batch.column(2).to_numpy() * np.where(nulls, -1, 1)
        yield pa.record_batch([batch.column(0), as_bytes(rows, np.arange(len(rows)))], ["term", "posts"])


def impacts(rows: np.ndarray, mean: float, k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b) -> np.ndarray:
    """``saturation`` of postings."""
    tf = np.abs(rows["tf"])
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * rows["dl"] / mean))


def in_impact_order(mean: float, block: int, most: int):
    """A function from (term, posts, bucket) to blocks of postings: ``most`` at a time are put in order of their impacts."""

    def blocks(held: list) -> pa.RecordBatch:
        terms = pa.concat_arrays([x.column(0) for x in held]).dictionary_encode()
        number = terms.indices.to_numpy()
        bucket = np.zeros(len(terms.dictionary), np.int32)
        bucket[number] = np.concatenate([x.column(2).to_numpy() for x in held])
        each_ = [from_bytes(x.column(1), POST) for x in held]
        rows, code = np.concatenate([x for x, _ in each_]), np.repeat(number, np.concatenate([n for _, n in each_]))
        impact = impacts(rows, mean)
        order = np.lexsort((rows["id"], -impact, code))
        rows, code, impact = rows[order], code[order], impact[order]
        first = np.flatnonzero(np.r_[True, np.diff(code) != 0])
        at = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        starts = np.flatnonzero(at % block == 0)
        own = code[starts]
        return pa.record_batch([terms.dictionary.take(pa.array(own)), pa.array((at[starts] // block).astype(np.int32)), as_bytes(rows, starts), pa.array(impact[starts]), pa.array(bucket[own])], ["term", "block", "posts", "impact", "bucket"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.column(1).nbytes // POST.itemsize
            if n >= most:
                yield blocks(held)
                held, n = [], 0
        if held:
            yield blocks(held)

    return run


def largest(mean: float, block: int):
    """A function from blocks (term, block, posts, bucket) to (term, df, tops, bucket); of blocks whose impacts can't be among the
    term's largest, only df."""

    def run(batches):
        for batch in batches:
            rows, sizes = from_bytes(batch.column(2), POST)
            kept = np.where(batch.column(1).to_numpy().astype(np.int64) * block < TOPS, sizes, 0)
            tops = impacts(rows, mean)[np.repeat(kept > 0, sizes)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept)), pa.int32()), pa.array(tops))
            yield pa.record_batch([batch.column(0), pa.array(sizes.astype(np.int64)), lists, batch.column(3)], ["term", "df", "tops", "bucket"])

    return run


def dealt_by_chunk(shared, parts: int):
    """A function from blocks (term, posts) to (part, posts): the postings of each part of the chunks, with their terms' numbers."""

    def run(batches):
        term_at = shared.value[0]
        for batch in batches:
            if not batch.num_rows:
                continue
            posts, sizes = from_bytes(batch.column(1), POST)
            ids = np.ascontiguousarray(posts["id"])
            terms = batch.column(0).dictionary_encode()
            number = np.array([term_at[t] for t in terms.dictionary.to_pylist()], np.int32)[terms.indices.to_numpy()]
            rows = np.zeros(len(ids), FOUND)
            rows["id"], rows["tf"], rows["dl"], rows["term"] = ids, posts["tf"], posts["dl"], np.repeat(number, sizes)
            part = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
            yield pa.record_batch([pa.array(part[order][starts].astype(np.int32)), as_bytes(rows[order], starts)], ["part", "posts"])

    return run


def best_of_part(shared, k: int, mean: float):
    """A function from a part's (part, posts) to (q, chunk_id, score): what may be among the k best of each question."""

    def run(table: pa.Table) -> pa.Table:
        _, weights, questions = shared.value
        rows = np.concatenate([from_bytes(c, FOUND)[0] for c in table.column("posts").chunks])
        rows = rows[np.argsort(rows["term"], kind="stable")]
        starts = np.searchsorted(rows["term"], np.arange(len(weights) + 1))
        null = rows["tf"] < 0
        ids, at = np.unique(rows["id"], return_inverse=True)
        nulls = np.append(np.zeros(len(ids), bool), True)  # the chunk without an id stands last
        ids, at = np.append(ids, 0), np.where(null, len(ids), at)
        part, out = weights[rows["term"]] * impacts(rows, mean), []
        for q, own in enumerate(questions):
            score = np.zeros(len(ids))
            for t in own:
                mine = slice(starts[t], starts[t + 1])
                score[at[mine]] += part[mine]  # a chunk stands once at a term
            found = np.flatnonzero(score)
            if len(found) > k:  # what ties with the k-th to six places stays for the ranks; of equal scores the smaller chunks
                found = found[score[found] >= np.partition(score[found], -k)[-k] - 1.1e-6]
                _, found = R.smallest_of_equals(score[found], found, k)
            out.append((np.full(len(found), q, np.int32), found, score[found]))
        q, found, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"q": q, "chunk_id": pa.array(ids[found], mask=nulls[found]), "score": score})

    return run
