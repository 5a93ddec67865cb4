"""Shared pieces of the training-data operators: inputs, scratch tables, Arrow column functions, word caches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch: whole texts travel, so a batch of long documents must stay in tens of megabytes.
BATCH_ROWS = 2000

#: Bytes per Arrow batch where ``bounded_bytes`` is asked for; one row of more makes a batch of its own.
BATCH_BYTES = 4 << 20

#: Lower-cases A-Z, keeps 0-9, a-z and all bytes from 0x80, and turns every other byte into a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """Bounds the rows of one Arrow batch for the session's Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def bounded_bytes(spark: SparkSession, most: int = BATCH_BYTES) -> SparkSession:
    """Bounds the bytes of one Arrow batch as well, whatever the texts' lengths: executors and their workers hold some at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, in the folder that ``spark.checkpoint.dir`` names.

    Where the setting is absent in a session of one process (tests), it gets a temporary one; a cluster must name its own.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def boxed(docs: DataFrame, **needed: Column) -> DataFrame:
    """(row, needed...): all columns in one struct, so that no name of theirs meets a name of an operator's own."""
    names = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    return docs.select(F.struct(*names).alias("row"), *[c.alias(name) for name, c in needed.items()])


def unboxed(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from rows of ``boxed``, some of them changed."""
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and returns them as read from there. Row groups are small, as a
    writing task holds one in memory."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes scratch tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def few(df: DataFrame, rows: int = 1 << 19) -> DataFrame:
    """Marked for broadcast where its rows (of a few longs each) are counted to be few; else the engine joins by sorting."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sorted_side(df: DataFrame) -> DataFrame:
    """Marked for a join by sorting. Spark sizes a stored table by its compressed files and an explode as one row out of one, so
    it would send to the driver, and from there to all, what is many times its threshold."""
    return df.hint("merge")


class Bits:
    """A Bloom filter of a column of 64-bit hashes, shared with the tasks: ``there`` is false only where no row has the value.

    Three bits for each row among 32 to 64 times as many, ``most`` in all. Up to that one other value in a thousand passes;
    beyond it (``full``) more do: it spares a shuffle, what is exact follows it.
    """

    SHIFTS = (0, 19, 37)

    def __init__(self, nodes: DataFrame, column: str, most: int = 1 << 28):
        n = nodes.count()
        self.bits, self.full = min(most, max(1 << 16, 1 << (32 * n).bit_length())), 12 * n > most
        mask = F.lit(self.bits - 1)
        spots = F.explode(F.array(*[F.shiftrightunsigned(F.col(column), s).bitwiseAND(mask) for s in self.SHIFTS]))
        words = nodes.select(spots.alias("at")).select(F.shiftright("at", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
        got = words.groupBy("w").agg(F.expr("bit_or(bit)").alias("b")).toArrow()
        table_ = np.zeros(self.bits // 64, np.uint64)
        table_[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
        self.shared = nodes.sparkSession.sparkContext.broadcast(table_)

    def there(self, values: np.ndarray) -> np.ndarray:
        table_, values, out = self.shared.value, values.view(np.uint64), np.ones(len(values), bool)
        for s in self.SHIFTS:
            at = (values >> np.uint64(s)) & np.uint64(self.bits - 1)
            out &= (table_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def maybe(nodes: DataFrame, column: str):
    """``Bits.there`` as a function of a column."""
    bits = Bits(nodes, column)

    @F.arrow_udf("boolean")
    def there(values: pa.Array) -> pa.Array:
        return pa.array(bits.there(values.to_numpy(zero_copy_only=False)))

    return there


def map_column(make: Callable[[], Callable[[list], pa.Array]], kind: str):
    """An Arrow column function: ``make()`` runs once for a worker's task and returns batch -> array."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work, batch = make(), None
        for batch in batches:
            yield work(batch.to_pylist())
        del work, batch
        give_back()

    return run


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with per-task state; ``make()`` returns a function from one batch to batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, batch = make(), None
        for batch in batches:
            yield from work(batch)
        del work, batch
        give_back()

    return df.mapInArrow(run, schema)


class Cache(dict):
    """A bounded memo of two generations: ``cache[x]`` computes on a miss; when the young one is full it becomes the old
    one, so that what is used again stays and what is not goes."""

    def __init__(self, compute: Callable, most: int = 250_000):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """What a Python worker keeps between its tasks: one object, the last one asked for, so that the memos of earlier stages
    don't add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops what the worker keeps; for stages that keep nothing and need the room."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def give_back() -> None:
    """Returns memory that is free in the worker to the system: Spark reuses workers, and idle ones count as their executor's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU library has it
        trim(0)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of 0-9, a-z and everything beyond ASCII, as UTF-8."""
    return text.encode().translate(WORD_BYTES).split() if text else []
