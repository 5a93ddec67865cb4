"""Passages of ``words`` whole words that stand byte for byte in two or more texts, whatever their length in bytes.

A window reaches from the first byte of a word to the last byte of the ``words``-th from it. As in operator 8, each window is
owned by its smallest hashed ``gram`` of words, and owners whose hash occurs once own no shared window. The windows of the
others are counted by a 128-bit hash of their bytes; those of two distinct texts are shared, and their bytes are the passages.
No window is joined to the next one unless it is shared itself, so neighbours that repeat in unlike places add up to nothing.

Words are runs of 0-9, A-Z, a-z and everything beyond ASCII.

Defined cases: null counts as empty; texts of fewer words share nothing; what repeats within one text alone is not shared;
a text that occurs in several rows is shared as a whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import WORD_BYTES, bounded_batches, drop_written, map_rows, written
from siltstone.llm.suffix import PIECE, copies, owned, packed, repeated_owners, sources, span_hashes, texts_with


@dataclass(frozen=True)
class Params:
    words: int = 51
    gram: int = 16  # words

    @property
    def length(self) -> int:
        """The fewest bytes of a window: words of one letter with one blank between."""
        return 2 * self.words - 1


#: Words of a text in a row, as ``word_places`` finds them.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
LETTER = np.frombuffer(WORD_BYTES, np.uint8) != 32


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of each word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = LETTER[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_owners(data: np.ndarray, p: Params) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner hashes, first window, last window) of a text's windows, by pieces; places count words of the text."""
    starts, ends = word_places(data)
    out = []
    for base in range(0, max(0, len(starts) - p.words + 1), PIECE):
        a, b = starts[base : base + PIECE + p.words - 1], ends[base : base + PIECE + p.words - 1]
        h = span_hashes(data[a[0] : b[-1]], a[: len(a) - p.gram + 1] - a[0], b[p.gram - 1 :] - a[0])
        out.append(owned(h, p.words - p.gram + 1, base))
    return out


def window_rows(texts: DataFrame, p: Params) -> DataFrame:
    """(h1, h2, sig, first, last): hash, text and bytes of each window of the repeated owners of ``texts_with``."""

    def make():
        def work(batch: pa.RecordBatch):
            for sig, raw, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                view = memoryview(raw.as_buffer())
                data = np.frombuffer(view, np.uint8)
                starts, ends = word_places(data)
                wanted = np.unique(places.values.to_numpy())
                for _, first, last in word_owners(data, p):
                    at = np.isin(first, wanted)
                    size = last[at] - first[at] + 1
                    k = np.arange(size.sum()) + np.repeat(first[at] - np.cumsum(size) + size, size)
                    a, b = starts[k], ends[k + p.words - 1]
                    digest = b"".join(xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True))
                    h = np.frombuffer(digest, np.int64).reshape(-1, 2)
                    cols = [pa.array(c) for c in (h[:, 0].copy(), h[:, 1].copy())] + [pa.array([sig] * len(k), pa.binary())]
                    yield pa.record_batch(cols + [pa.array(c.astype(np.int64)) for c in (a, b)], ["h1", "h2", "sig", "first", "last"])

        return work

    return map_rows(texts.select("item", "data", "places"), packed(make), "h1 long, h2 long, sig binary, first long, last long")


def shared_spans(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """(sig, firsts, lasts): for each text with shared passages their windows as arrays, as ``suffix.repeated_spans`` has them."""
    spark = bounded_batches(docs.sparkSession, 500)
    src = sources(docs, text)
    places = repeated_owners(src, p, word_owners)
    windows = written(window_rows(texts_with(src, places, p.length), p), "word-windows")
    bounded_batches(spark)
    in_text = F.xxhash64("sig")
    shared = windows.groupBy("h1", "h2").agg(F.min(in_text).alias("a"), F.max(in_text).alias("b")).where("a < b").select("h1", "h2")
    again = windows.join(shared, ["h1", "h2"]).select("sig", "first", "last")
    words = F.regexp_count(F.col("data").cast("string"), F.lit(WORD))
    whole = copies(src.where(words >= p.words), p.length).select("sig", F.lit(0).cast("long").alias("first"), "last")
    every = again.unionByName(whole)
    out = written(every.groupBy("sig").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")), "passages")
    drop_written(spark, places, windows)
    return out
