"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All but the last return the columns
of ``documents``, extra ones included, whatever their names. Null and empty texts pass all stages; a null id is a document
like any other; an empty table gives no rows; texts of any length are taken whole.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, decontaminate, jaccard, passages, suffix, toxicity
from siltstone.llm.common import bounded_batches, bounded_bytes, boxed, maybe, table, unboxed, written

#: Near duplicates: shingles of five words, similarity of 0.8 or more.
NEAR = jaccard.Params(size=5, num=80, den=100)


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any toxic grade reaches the decision threshold go; null and empty texts stay, repeated
    rows share one fate. Without labels of both kinds nothing is toxic."""
    bounded_bytes(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = boxed(docs, severity=toxicity.severity(F.col("text").cast("string"), model))
    return unboxed(rows.where("not severity.toxic"), docs)


def one_of_each_group_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the one of smallest id stays, once if rows repeat it; unlike texts under one id are documents of
    their own; rows without an id stay, and so do null, empty and wordless texts, once for each id. Of rows that are alike in id
    and set one stays."""
    bounded_bytes(spark)
    places = written(jaccard.placed(docs, NEAR).where("doc_id is not null"), "components")
    again = written(places.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id")), "repeated-ids")
    first = places.where("component_id = doc_id").select(F.col("doc_id").alias("id"), "sig", "root")
    # most documents stay: only those whose id may be one that goes or is repeated are dealt by id, texts and all
    going = places.where("component_id <> doc_id").select(F.col("doc_id").alias("id"))
    asked = written(going.unionByName(again).select("id", F.xxhash64("id").alias("key")).distinct(), "asked-ids")
    rows = boxed(docs, id=F.col("doc_id").cast("long"), text=F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumn("open", F.col("id").isNotNull() & maybe(asked, "key")(F.xxhash64("id")))
    sure, open_ = rows.where("not open"), rows.where("open")
    once = open_.join(asked.select("id"), "id", "left_anti")
    # an id of several rows tells neither its texts nor their components apart, their sets do
    kept = first.where("sig is not null").groupBy("id", "root").agg(F.min("sig").alias("sig")).join(again, "id", "left_semi")
    several = open_.join(again, "id", "left_semi").withColumn("sig", jaccard.signatures(NEAR)("text"))
    alike = several.join(kept, ["id", "sig"], "left_semi").dropDuplicates(["id", "sig"])
    wordless = several.where("sig is null").dropDuplicates(["id", "text"])
    every = [x.select("row") for x in (sure, once, alike, wordless)]
    return unboxed(reduce(DataFrame.unionByName, every), docs)


def repeated_strings_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that also start elsewhere and passages of over 50 words that stand in other texts too are cut out
    of the texts; n_chars follows. No row goes; a text that stands in several rows goes whole, from each of them; what is cut
    in the middle of a character takes the character along."""
    bounded_bytes(spark)
    return suffix.without_repeats(docs, more=passages.shared_spans(docs)).withColumn("n_chars", F.length("text").cast("long"))


def leaking_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, repeated ones each. Items without words match nothing."""
    bounded_bytes(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text as decoded from them; a null text counts as empty; every row is encoded."""
    bounded_bytes(spark)
    rows = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", toxic_documents_go),
    ("near_duplicates", one_of_each_group_stays),
    ("repeated_strings", repeated_strings_go),
    ("benchmark_leaks", leaking_documents_go),
    ("byte_bpe", encoded),
]

#: SQL can't express the stages; tests/llm holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(bounded_batches(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
