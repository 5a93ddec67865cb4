"""A stored table of a model's answers by content: texts that were asked before, in whatever run, aren't asked again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.commits import Commits

SCHEMA = "content string, answer string, gen int"


@dataclass(frozen=True)
class Extractions:
    """Answers of one model and prompt (``version``), by the hash of the text. A text without an answer (null) is asked again."""

    spark: SparkSession
    path: str
    version: str

    @property
    def commits(self) -> Commits:
        return Commits(self.spark, f"{self.path}/{self.version}")

    def stored(self) -> DataFrame:
        """(content, answer): the newest answer to each text."""
        rows = self.commits.read("answers", SCHEMA)
        return rows.groupBy("content").agg(F.max_by("answer", "gen").alias("answer"))

    def answers(self, texts: DataFrame, ask: Callable[[list[str]], list[str | None]], text: str = "text", batch: int = 32) -> DataFrame:
        """The rows with answer. Distinct new texts go to ``ask`` in lists of at most ``batch``, in the order of their hash within a
        task; what it gives is published before it is used. An error of ``ask`` ends its list with nulls, others go on."""
        rows = texts.withColumn("content", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        known = self.stored()
        new = rows.where(F.coalesce(F.col(text), F.lit("")) != "").select("content", F.col(text).alias("asked")).dropDuplicates(["content"]).join(known, "content", "left_anti")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                for at in range(0, part.num_rows, batch):
                    some = part.slice(at, batch)
                    try:
                        got = list(ask(some.column(1).to_pylist()))
                    except Exception:  # the list's texts stay unanswered and are asked again by the next run
                        got = [None] * some.num_rows
                    yield pa.record_batch([some.column(0), pa.array(got, pa.string())], ["content", "answer"])

        base = self.commits.manifest()
        folder = self.commits.folder("answers", base["version"] + 1)
        asked = new.repartition("content").sortWithinPartitions("content").mapInArrow(run, "content string, answer string")
        asked.where("answer is not null").write.parquet(folder)
        if self.spark.read.schema("content string").parquet(folder).head(1):
            self.commits.publish(base, {"answers": [folder]}, base["info"])
        return rows.join(self.stored(), "content", "left").drop("content")

    def evict(self, keep: DataFrame, text: str = "text") -> int:
        """Leaves only answers to ``keep``'s texts, as one generation; returns how many went."""
        base, all_ = self.commits.manifest(), self.stored()
        left = all_.join(keep.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content")).distinct(), "content", "left_semi")
        folder = self.commits.folder("answers", base["version"] + 1)
        left.write.parquet(folder)
        before = all_.count()
        self.commits.publish(base, {"answers": [folder]}, base["info"], replace=True)
        return before - self.stored().count()
