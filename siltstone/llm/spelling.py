"""Spelling variants (operator 12): an even-partition pigeonhole join of words one edit apart.

1. Words. Runs of letters are counted within a task and added up in one shuffle; those of enough letters and occurrences stay.
2. Partition. A word of length l is cut into two segments of l // 2 and l - l // 2 letters. One inserted, deleted or replaced
   letter leaves one of them whole, at the same place in a word of equal length or one longer: the first at the start, the
   second shifted to the end. So each word indexes its own two segments, and words of l and l + 1 letters probe them.
3. What the segment leaves over is cut evenly once more: as the edit lies there, one of its halves stays whole too, again at the
   start or shifted to the end. A key is a segment with such a half, so that the words of one frequent segment (a prefix, an
   ending) don't all meet. Keys are 64-bit hashes; what meets by chance doesn't pass the next step.
4. Candidates are verified by edit distance, and what met at several keys counts once.
5. Forms. A word's form is its near word of most occurrences, if it has ``ratio`` times as many. Forms have ever more
   occurrences, so they lead to a root without circles; pointers are doubled until none moves.

Defined cases: a null text has no words; a null id counts as '' in the hash; repeated rows count each; words of equal
occurrences tie by code points; texts of any length are taken whole; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_batches, drop_written, forget, sorted_side, written

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Params:
    letters: str = "A-Za-zÀ-ÿ"
    min_letters: int = 7
    min_count: int = 2
    ratio: int = 10  # a form has so many times the word's occurrences
    odd: int = 31  # words whose hash it divides lose a letter; 0: none does
    task_words: int = 400_000  # counts that a task holds before it sends them on


def misspelt(doc_id, word: str, odd: int) -> str:
    """The word without the letter that its hash names, if ``odd`` divides the hash."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % odd:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def words(docs: DataFrame, p: Params, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of at least ``min_letters`` letters and ``min_count`` occurrences, lower-cased in A-Z."""
    runs = re.compile(f"[{p.letters}]{{{p.min_letters},}}")  # shorter runs give no word, as no run grows

    def sent(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches):
        forget()
        held: Counter = Counter()
        for batch in batches:
            for row, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = Counter(runs.findall(content.encode().translate(LOWER).decode()))
                if p.odd:
                    for word, n in found.items():
                        word = misspelt(row, word, p.odd)
                        if len(word) >= p.min_letters:
                            held[word] += n
                else:
                    held.update(found)
                if len(held) >= p.task_words:
                    yield sent(held)
                    held = Counter()
        if held:
            yield sent(held)

    rows = docs.select(F.col(doc_id).alias("row"), F.col(text).cast("string").alias("content")).where("content is not null")
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= p.min_count)


def keys(word: Column, length: Column) -> list[Column]:
    """The keys by which a word of ``length`` letters or one more meets words of ``length`` letters."""
    own = F.length(word)
    first, second = F.floor(length / 2).cast("int"), (length - F.floor(length / 2)).cast("int")

    def halves(rest: Column, whole: Column) -> list[tuple[Column, Column]]:
        left = F.floor(whole / 2).cast("int")
        right = whole - left
        return [(F.lit(0), F.substring(rest, F.lit(1), left)), (F.lit(1), F.substring(rest, F.length(rest) - right + 1, right))]

    start, end = F.substring(word, F.lit(1), first), F.substring(word, own - second + 1, second)
    after, before = F.substring(word, first + 1, own - first), F.substring(word, F.lit(1), own - second)
    out = [F.xxhash64(length, F.lit(0), start, which, half) for which, half in halves(after, second)]
    return out + [F.xxhash64(length, F.lit(1), end, which, half) for which, half in halves(before, first)]


def near(counted: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every two words one edit apart, both ways, from (word, n)."""
    word, length = F.col("word"), F.length("word")
    index = counted.select(F.explode(F.array(*keys(word, length))).alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    probes = F.array(*keys(word, length), *keys(word, length - 1))
    asked = counted.select(F.explode(probes).alias("key"), "word", "n")
    # of words of equal length one direction is enough; a longer word probes the shorter one
    ahead = (F.length("word") > F.length("other")) | ((F.length("word") == F.length("other")) & (word < F.col("other")))
    met = asked.join(sorted_side(index), "key").where(ahead & (F.levenshtein("word", "other", 1) == 1))
    once = met.select("word", "n", "other", "other_n").distinct()
    back = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return once.select(F.explode(back).alias("x")).select("x.*")


def forms(counted: DataFrame, p: Params) -> DataFrame:
    """(word, n, n_near, form, form_n) from (word, n)."""
    best = near(counted).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    rows = counted.join(sorted_side(best), "word", "left").withColumn("form_n", -F.col("best.less"))
    chosen = F.col("form_n") >= p.ratio * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, F.col("form_n")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form."""
    now = written(formed.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(now.join(sorted_side(then), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_written(now.sparkSession, now)
        now = moved.drop("moved")
        if not moved.where("moved").head(1):
            return now


def variants(docs: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n)."""
    spark = bounded_batches(docs.sparkSession)
    counted = written(words(docs, params, doc_id, text), "words")
    formed = written(forms(counted, params), "formed")
    drop_written(spark, counted)
    rows = formed.join(sorted_side(roots(formed)), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
