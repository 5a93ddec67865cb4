"""Byte-level BPE encoding and decoding by a ranked vocabulary (operator 10).

``encode`` pre-tokenizes each text by the vocabulary's pattern, folds the ranked merges over the bytes of each distinct
piece, and decodes the ids again by concatenating the binary pieces. ``encode_words_native`` does the fold with Spark's
higher-order functions over a table of distinct words; the README tells why whole texts take the worker-side fold.

Defined cases: a null text counts as empty and yields no ids; ties of equal ranks merge the leftmost pair first; repeated
rows are encoded each; extra input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Cache, bounded_batches, kept, map_rows

#: White space other than a blank and a line feed; texts with it take the whole pattern instead of the cut at blanks.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: A run of blanks with what follows it. No piece of the pattern spans the border between two such parts.
PART = re.compile("[ \n]*[^ \n]+|[ \n]+")
#: Ids in one batch of results; a text of more makes a batch of its own.
BATCH_IDS = 1 << 17
#: Parts and pieces in a generation of the memos of ``encode``, whose rows carry texts and ids beside them. They go with the task.
MEMO = 50_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file has one ``base64 rank`` pair on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Folds the merges over one piece: join the leftmost adjacent pair of the lowest rank until none is ranked."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
    while True:
        best, at = None, -1
        for i, rank in enumerate(pair):
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        pair[at : at + 1] = []
        if at:
            pair[at - 1] = ranks.get(parts[at - 1] + parts[at])
        if at < len(pair):
            pair[at] = ranks.get(parts[at] + parts[at + 1])


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold for long pieces, with a heap, so that a run of thousands of letters stays cheap."""
    import heapq

    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = []

    def push(i: int) -> None:
        j = right[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
            continue
        alive[mid] = False
        end[i], right[i] = stop, right[mid]
        if right[i] < n:
            left[right[i]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Texts to ids as decimal words joined by blanks, with memos for parts of texts. Nothing in it refers to itself, so that the
    memos are free as soon as nobody has it."""

    def __init__(self, path: str, pattern: str, most: int = 250_000, ranks: dict[bytes, int] | None = None):
        import regex

        ranks = load_ranks(path) if ranks is None else ranks
        find = regex.compile(pattern).findall

        def piece(text: str) -> str:
            raw = text.encode()
            return " ".join(map(str, merge(raw, ranks) if len(raw) < 64 else merge_long(raw, ranks)))

        small = Cache(piece, most)

        def part(text: str) -> str:
            return " ".join(map(small.__getitem__, find(text)))

        self.pieces = {str(v): k for k, v in ranks.items()}
        self.part, self.cache = part, Cache(part, most)

    def encode(self, text: str) -> str:
        if OTHER_SPACE.search(text):
            return self.part(text)
        return " ".join(map(self.cache.__getitem__, PART.findall(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.split(" "))) if ids else b""


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids (array of int), decoded (binary)."""

    def make():
        code = Encoder(path, pattern, MEMO, kept(("ranks", path), lambda: load_ranks(path)))

        def work(batch: pa.RecordBatch):
            docs_, lists, raw, size = [], [], [], 0

            def rows() -> pa.RecordBatch:
                starts = np.cumsum([0, *map(len, lists)])
                ids = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
                return pa.record_batch([pa.array(docs_, pa.int64()), pa.array(np.diff(starts), pa.int64()), ids, pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

            for i, t in zip(*batch.columns, strict=True):
                ids = code.encode(t.as_py() or "")
                docs_.append(i.as_py())
                lists.append(np.fromstring(ids, np.int32, sep=" "))
                raw.append(code.decode(ids))
                size += len(lists[-1])
                if size >= BATCH_IDS:
                    yield rows()
                    docs_, lists, raw, size = [], [], [], 0
            if docs_:
                yield rows()

        return work

    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_rows(src, make, "doc_id long, n_tokens long, ids array<int>, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, sha256 of the ids (decimal, joined by one blank), sha256 of the bytes decoded from them."""

    def make():
        code = kept(("bpe", path, pattern), lambda: Encoder(path, pattern))

        def work(batch: pa.RecordBatch):
            n, a, b = [], [], []
            for t in batch.column(1).to_pylist():
                ids = code.encode(t or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(code.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_rows(src, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def fold_native(word: Column, rank_map: Column) -> Column:
    """The merge fold as one Catalyst expression: an array of binary pieces for a binary word.

    Each step of the outer fold joins the leftmost pair of the lowest rank; a word of n bytes needs at most n - 1 steps.
    """
    parts = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
    none = F.lit(2**31 - 1)

    def step(acc: Column, _: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))),
            lambda i: F.coalesce(F.try_element_at(rank_map, F.concat(F.try_element_at(acc, i), F.try_element_at(acc, i + 1))), none),
        )
        best = F.array_min(pairs)
        at = F.array_position(pairs, best).cast("int")
        joined = F.concat(
            F.slice(acc, F.lit(1), at - 1),
            F.array(F.concat(F.try_element_at(acc, at), F.try_element_at(acc, at + 1))),
            F.slice(acc, at + 2, F.size(acc)),
        )
        return F.when(best < none, joined).otherwise(acc)

    return F.when(F.length(word) == 0, F.array().cast("array<binary>")).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(word)), parts, step))


def encode_words_native(words: DataFrame, ranks: DataFrame, word: str = "word") -> DataFrame:
    """(word, ids array<int>, decoded binary) for a table of distinct binary words, by DataFrame functions alone.

    ``ranks`` (piece binary, rank int) is the vocabulary, bounded by its file. Each word gets the literal map of those of
    its own substrings that are ranked, since a lookup in a map of the whole vocabulary would scan it.
    """
    n = F.length("word")
    starts = F.sequence(F.lit(1), n)
    subs = F.array_distinct(
        F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i, n), lambda j: F.substring(F.col("word"), i, j - i + 1))))
    )
    distinct = words.select(F.col(word).cast("binary").alias("word")).where("length(word) > 0").distinct()
    known = (
        distinct.select("word", F.explode(subs).alias("piece"))
        .join(F.broadcast(ranks.select("piece", "rank")), "piece")
        .groupBy("word")
        .agg(F.map_from_entries(F.collect_list(F.struct("piece", "rank"))).alias("known"))
    )
    pieces = known.select("word", "known", fold_native(F.col("word"), F.col("known")).alias("pieces"))
    return pieces.select(
        "word",
        F.transform("pieces", lambda p: F.element_at("known", p)).alias("ids"),
        F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p)).alias("decoded"),
    )
