"""Joins over ranges and ranks without a task for each key: intervals by bands, the nearest row before, neighbours in order, and
rank selection.

A key may hold a third of all rows. Intervals meet in bands of a width, orders are cut into blocks of a width whose border rows
alone are exchanged, and ranks are found by counts in narrowing bins, so no task holds more than a band, a block, or the counts
of a key's bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.retrieval import small
from siltstone.plans.lineage import cut

BINS = 16  # bits that one pass of ``ranked`` tells apart


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of rows of equal ``keys`` whose closed intervals [lo, hi] have a point in common, each pair once.

    Both sides have keys, lo and hi (numbers), the right one's other columns must be named differently; the result has the keys,
    the left columns, and the right ones with lo and hi as r_lo and r_hi. Intervals stand in every band of ``width`` that they
    touch and pairs count in the first one they share: choose about the usual length. Rows whose lo, hi or key is null, or whose
    lo is above hi, meet nothing.
    """
    band = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = lambda df: df.where("lo <= hi").withColumn("band", F.explode(F.sequence(band("lo"), band("hi"))))
    other = spread(right).withColumnsRenamed({"lo": "r_lo", "hi": "r_hi"})
    met = spread(left).join(other, [*keys, "band"]).where((F.col("lo") <= F.col("r_hi")) & (F.col("r_lo") <= F.col("hi")))
    return met.where(F.col("band") == F.greatest(band("lo"), band("r_lo"))).drop("band")


def neighbours(rows: DataFrame, keys: list[str], at: str, value: Column, width: int) -> DataFrame:
    """The rows with before and after: ``value`` of the row before and after in a key's order by ``at`` (a whole number, unique in
    its key), null at the ends. Blocks of ``width`` numbers are ordered by themselves, their border rows by one another."""
    block = F.floor(F.col(at) / width).cast("long")
    held = rows.withColumn("__block", block).withColumn("__value", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, "__block").orderBy(at)
    edges = held.groupBy(*keys, "__block").agg(F.max_by("__value", at).alias("__last"), F.min_by("__value", at).alias("__first"))
    across = Window.partitionBy(*keys).orderBy("__block")
    edges = edges.select(*keys, "__block", F.lag("__last").over(across).alias("__left"), F.lead("__first").over(across).alias("__right"))
    marked = held.withColumn("__lag", F.lag("__value").over(inside)).withColumn("__lead", F.lead("__value").over(inside))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.__block") == F.col("b.__block")]
    joined = marked.alias("a").join(small(edges, 200_000).alias("b"), same, "left")
    out = [F.coalesce(F.col("a.__lag"), F.col("b.__left"))["v"].alias("before"), F.coalesce(F.col("a.__lead"), F.col("b.__right"))["v"].alias("after")]
    return joined.select(*[F.col(f"a.`{c}`") for c in rows.columns], *out)


def as_of(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """The rows (keys, at, ...) with mark_at and mark: those of the newest of ``marks`` (keys, at, mark) at or before them in their
    key; of marks at one place the greatest counts. One sort of both sides in blocks of ``width``; the last mark of a block is
    handed to the next ones."""
    rest = [c for c in rows.columns if c not in (*keys, at)]
    one = rows.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in rest] or [F.lit(0)]).alias("__row"), F.lit(None).alias("__mark"))
    found = F.struct(F.col(at).alias("at"), F.col("mark").alias("mark"))
    two = marks.groupBy(*keys, at).agg(F.max("mark").alias("mark")).select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).alias("__row"), found.alias("__mark"))
    both = one.unionByName(two).withColumn("__block", F.floor(F.col("__at") / width).cast("long"))
    inside = Window.partitionBy(*keys, "__block").orderBy("__at", "__side")
    last = both.groupBy(*keys, "__block").agg(F.max_by("__mark", F.when(F.col("__mark").isNotNull(), F.col("__at"))).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.select(*keys, "__block", F.last("__last", True).over(across).alias("__handed"))
    seen = both.withColumn("__seen", F.last("__mark", True).over(inside)).where("__side = 1")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.__block") == F.col("b.__block")]
    joined = seen.alias("a").join(small(handed, 200_000).alias("b"), same, "left")
    got = F.coalesce(F.col("a.__seen"), F.col("b.__handed"))
    return joined.select(*[F.col(f"a.{k}") for k in keys], F.col("a.__at").alias(at), *[F.col("a.__row")[c].alias(c) for c in rest], got["at"].alias("mark_at"), got["mark"].alias("mark"))


def ranked(rows: DataFrame, keys: list[str], value: str, rank: Column) -> DataFrame:
    """(keys, value): of each key the value of a rank from 1 in ascending order; ``rank`` is an expression of the key's number of
    rows, n. Values are longs of 0 or more; nulls and other keys' rows don't count.

    Each pass counts rows by the next ``BINS`` bits of their values, before the shuffle, and goes on with the bin that the rank
    falls into; so a key's task sees at most 2^BINS counts.
    """
    rows = rows.where(F.col(value) >= 0).select(*keys, F.col(value).cast("long").alias("value"))
    most = rows.agg(F.max("value")).first()[0]
    if most is None:
        return rows.select(*keys, F.col("value").alias(value))
    passes = -(-max(1, most.bit_length()) // BINS)
    wanted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.lit(0).cast("long").alias("high"), rank.cast("long").alias("rank"))
    for k in range(passes - 1, -1, -1):
        bin_ = F.shiftright("value", k * BINS)
        alive = rows.withColumn("high", F.shiftright("value", (k + 1) * BINS) if k + 1 < passes else F.lit(0).cast("long")).withColumn("bin", bin_)
        counts = alive.groupBy(*keys, "high", "bin").agg(F.count(F.lit(1)).alias("n")).join(small(wanted, 200_000), [*keys, "high"])
        below = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("n")
        placed = counts.withColumn("below", below).where((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("n")))
        wanted = cut(placed.select(*keys, F.col("bin").alias("high"), (F.col("rank") - F.col("below")).alias("rank")))
    return wanted.select(*keys, F.col("high").alias(value))
