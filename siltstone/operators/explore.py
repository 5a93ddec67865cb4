"""Browse, facets, counters, jobs, staging and upkeep over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import ranges


def tenant(rows: DataFrame, **equal) -> DataFrame:
    """Equality conditions; those given as None don't apply. They stand before any top-k."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def owned(rows: DataFrame, user_id: str, owner: str = "user_id") -> DataFrame:
    """Only a user's own rows; others are as if they weren't there, and rows without an owner belong to nobody."""
    return rows.where(F.col(owner) == F.lit(user_id))


def with_name(rows: DataFrame, named: DataFrame, on: str, key: str, name: str, default: str | None = None) -> DataFrame:
    """The rows with the name that ``named`` (key, name) has for them, else the default."""
    out = rows.join(named.select(F.col(key).alias("__key"), F.col(name).alias("__name")), F.col(on) == F.col("__key"), "left")
    return out.withColumn(name, F.coalesce("__name", F.lit(default))).drop("__key", "__name")


def page(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(100, limit)))


def facet_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, n) of several columns in one scan by grouping sets."""
    grouped = rows.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    width = len(columns)
    name = F.coalesce(*[F.when(F.col("g").bitwiseAND(F.lit(1 << (width - 1 - i))) == 0, F.lit(c)) for i, c in enumerate(columns)])
    value = F.coalesce(*[F.when(F.col("g").bitwiseAND(F.lit(1 << (width - 1 - i))) == 0, F.col(c).cast("string")) for i, c in enumerate(columns)])
    return grouped.select(name.alias("facet"), value.alias("value"), "n")


def context(chunks: DataFrame, doc: str, ordinal: str, text: str, width: int = 4096) -> DataFrame:
    """Each chunk with its predecessor's and successor's text, by blocks of ``width`` ordinals, so that no task holds a whole
    document; ordinals are unique in their document."""
    rows = ranges.neighbours(chunks, [doc], ordinal, F.col(text), width)
    return rows.withColumnsRenamed({"before": "context_before", "after": "context_after"})


def counters(documents: DataFrame, keys: list[str], status: Column, bytes_: Column, chunks: Column) -> DataFrame:
    """Per key: documents by state, bytes over all, chunks over ready ones."""
    ready = status == "ready"
    pending = status.isin("pending", "parsing", "embedding", "graphing")
    return documents.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(ready.cast("long")).alias("ready"),
        F.sum((status == "failed").cast("long")).alias("failed"),
        F.sum(pending.cast("long")).alias("pending"),
        F.coalesce(F.sum(bytes_), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.when(ready, chunks)), F.lit(0)).alias("chunks"),
    )


def job_states(events: DataFrame, job: str, ok: Column, failed: Column, total: Column) -> DataFrame:
    """One row a job from its event log: processed, failed, total, progress, state."""
    rolled = events.groupBy(job).agg(F.sum(ok.cast("long")).alias("done"), F.sum(failed.cast("long")).alias("failed"), F.max(total).alias("total"))
    processed = F.col("done") + F.col("failed")
    state = (
        F.when(processed == 0, "queued").when(processed < F.col("total"), "running").when(F.col("failed") == 0, "completed").when(F.col("done") == 0, "failed").otherwise("completed_with_errors")
    )
    return rolled.select(job, processed.alias("processed"), "failed", "total", progress(processed, F.col("total")).alias("progress"), state.alias("state"))


def progress(processed: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(F.least(F.lit(1.0), processed / total), 3)).otherwise(F.lit(0.0))


def latest(rows: DataFrame, key: str, at: list) -> DataFrame:
    """Keyed upsert: the last row of each key."""
    order = Window.partitionBy(key).orderBy(*[F.desc(a) for a in at])
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def changes(rows: DataFrame, key: str, at: str, payload: Column) -> DataFrame:
    """Only rows whose payload differs from the key's row before."""
    order = Window.partitionBy(key).orderBy(at)
    marked = rows.withColumn("payload", payload).withColumn("__n", F.row_number().over(order)).withColumn("__before", F.lag("payload").over(order))
    return marked.where(~F.col("payload").eqNullSafe(F.col("__before")) | (F.col("__n") == 1)).drop("__n", "__before")


def staged(files: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """(files, reason): null for those taken in; the first of ending, empty, size, first bytes, known hash, repeat in the batch.

    ``files`` has seq, name, size, head, sha256; ``known`` has sha256.
    """
    early = F.when(~T.allowed(F.col("name")), "extension").when(F.col("size") == 0, "empty").when(F.col("size") > cap, "size").when(~T.signature_fits(F.col("name"), F.col("head")), "signature")
    rows = files.withColumn("early", early).join(known.select("sha256").distinct().withColumn("known", F.lit(True)), "sha256", "left")
    order = Window.partitionBy("sha256", F.col("early").isNull()).orderBy("seq")
    again = F.row_number().over(order) > 1
    return rows.withColumn("reason", F.coalesce("early", F.when(F.col("known"), "known"), F.when(again, "repeated"))).drop("early", "known")


def exact_duplicates(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(sha256, copies, first) of contents that occur twice or more; partial counts are made before the shuffle."""
    return rows.groupBy(F.sha2(F.col(text), 256).alias("sha256")).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first")).where("copies > 1")


def field_signatures(rows: DataFrame, text: Column, pattern: str = r"\]\.(\w+)\s*=", least: float = 0.95) -> DataFrame:
    """One row: passages, with fields, the commonest field list and its count, and whether the corpus is made of such records."""
    fields = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    counted = rows.select(F.array_join(fields, ", ").alias("fields")).groupBy("fields").agg(F.count(F.lit(1)).alias("n"))
    some = F.when(F.col("fields") != "", F.col("n"))
    out = counted.agg(F.sum("n").alias("passages"), F.coalesce(F.sum(some), F.lit(0)).alias("structured"), F.max_by(F.when(F.col("fields") != "", F.col("fields")), F.struct(some, F.col("fields"))).alias("common"), F.max(some).alias("common_n"))
    uniform = (F.col("structured") >= least * F.col("passages")) & (F.col("common_n") >= least * F.col("structured"))
    return out.withColumn("uniform", F.coalesce(uniform, F.lit(False)))


def prose_profile(rows: DataFrame, filename: Column, page_no: Column, modality: Column) -> DataFrame:
    """One row: files, page span and modalities by falling count."""
    kinds = rows.groupBy(F.coalesce(modality, F.lit("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "kind"))), lambda r: F.concat((-r["o"]).cast("string"), F.lit(" "), r["kind"]))
    span = rows.agg(F.count(F.lit(1)).alias("passages"), F.count_distinct(F.when(filename != "", filename)).alias("files"), F.min(F.when(page_no > 0, page_no)).alias("first_page"), F.max(F.when(page_no > 0, page_no)).alias("last_page"))
    return span.crossJoin(F.broadcast(kinds.agg(F.array_join(listed, ", ").alias("kinds"))))  # one row each


def repeated_lines(pages: DataFrame, doc: str, page_no: str, text: str, share: float = 0.6) -> DataFrame:
    """(doc, line, pages): running heads, digits taken alike, on at least the share of a document's pages and on two or more."""
    lines = pages.select(doc, page_no, F.explode(F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(T.squeezed(x), "[0-9]", "#")))).alias("line"))
    total = pages.groupBy(doc).agg(F.count_distinct(page_no).alias("total")).where("total >= 3")
    counted = lines.where(F.length("line").between(3, 120)).distinct().groupBy(doc, "line").agg(F.count(F.lit(1)).alias("pages"))
    return counted.join(total, doc).where(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("total") * share))).select(doc, "line", "pages")


def without_furniture(lines: DataFrame, repeated: DataFrame, doc: str, margin: float = 0.07) -> DataFrame:
    """Lines (doc, text, y0, y1, height) but those in the top or bottom margin that are running heads of the document (as
    ``repeated_lines`` has them) or bare page numbers of up to four digits."""
    inside = (F.col("y1") > margin * F.col("height")) & (F.col("y0") < (1 - margin) * F.col("height"))
    shown = F.regexp_replace(T.squeezed(F.col("text")), "[0-9]", "#")
    marked = lines.withColumn("__line", shown).join(repeated.select(F.col(doc).alias("__doc"), F.col("line").alias("__head")).distinct(), (F.col(doc) == F.col("__doc")) & (F.col("__line") == F.col("__head")), "left")
    bare = F.trim("text").rlike("^[0-9]{1,4}$")
    return marked.where(inside | (F.col("__head").isNull() & ~bare)).select(*lines.columns)


def profile_line(documents: DataFrame, key: str, name: str, at: str, show: int = 6) -> DataFrame:
    """(key, profile): the first names and how many more there are. Only each partition's first ones are shuffled."""
    order = Window.partitionBy(key).orderBy(at, name)
    first = documents.select(key, name, at).withColumn("n", F.row_number().over(order)).where(F.col("n") <= show)
    listed = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(name).alias("name")))), lambda r: r["name"]), ", ").alias("names"))
    total = documents.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    more = F.when(F.col("total") > show, F.concat(F.lit(" and "), (F.col("total") - show).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return listed.join(total, key).select(key, F.concat("names", more).alias("profile"))


def orphaned(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def cascade(tables: dict[str, DataFrame], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the deleted keys."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}


def recovered(rows: DataFrame, status: str, running: tuple[str, ...], to: str = "failed") -> DataFrame:
    return rows.withColumn(status, F.when(F.col(status).isin(*running), to).otherwise(F.col(status)))


def nearest_above(items: DataFrame, titles: DataFrame, reach: float = 90.0, align: float = 40.0) -> DataFrame:
    """Each item's nearest aligned title above it on its page; items (item, page, x0, y0), titles (page, x0, y1, title)."""
    t = titles.select("page", F.col("y1").alias("lo"), F.col("y1").alias("hi"), F.col("x0").alias("tx"), "title")
    near = ranges.overlapping(items.withColumn("lo", F.col("y0") - reach).withColumn("hi", F.col("y0")), t, ["page"], reach)
    gap = F.col("y0") - F.col("r_hi")
    near = near.where((gap > 0) & (gap <= reach) & (F.abs(F.col("x0") - F.col("tx")) <= align))
    return near.groupBy("item").agg(F.min_by("title", F.struct(gap, F.col("title"))).alias("title"))


def nearest_caption(images: DataFrame, texts: DataFrame, reach: float = 120.0) -> DataFrame:
    """(image, caption): text by each image on its page; one that names its figure beats others, then the nearest counts.
    Images (image, page, y0, y1), texts (page, y0, y1, text)."""
    t = texts.select("page", F.col("y0").alias("lo"), F.col("y1").alias("hi"), "text")
    near = ranges.overlapping(images.withColumn("lo", F.col("y0") - reach).withColumn("hi", F.col("y1") + reach), t, ["page"], 2 * reach)
    gap = F.greatest(F.col("r_lo") - F.col("y1"), F.col("y0") - F.col("r_hi"), F.lit(0.0))
    plain = F.when(F.col("text").rlike(T.STANDALONE_CAPTION), 0).otherwise(1)
    return near.groupBy("image").agg(F.min_by("text", F.struct(plain, gap, F.col("text"))).alias("caption"))
