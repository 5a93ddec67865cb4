"""Suffix-array removal of repeated byte strings (operator 8).

Every byte covered by a string of ``length`` bytes that also starts elsewhere is removed. The work is cut so that suffixes
are sorted in bounded pieces and no match is lost:

1. Each window of ``length`` bytes is owned by its smallest hashed ``gram`` (ties to the left), so equal windows have equal
   owners at equal offsets. Owners whose hash occurs once own no repeated window.
2. The bytes of all windows of a repeated owner at one place are a context. Equal contexts are counted before any shuffle and
   travel once for each task; the places where they stand don't travel with them, but are joined to what is found.
3. Batches of whole owners' distinct contexts get a suffix array by two-stage sorting: only suffixes smaller than their
   successors are sorted directly, the others are induced by one scan over the buckets of first bytes. Adjacent suffixes with
   a common prefix of ``length`` bytes are one class; a class with two windows is a repeat.
4. Owners beyond ``group_bytes`` of distinct contexts are known from the counts. They are not dealt as they are: their contexts
   are cut by the owners of ever longer ``more_grams`` and counted and sorted like the first ones. The longest gram is a
   whole window, whose owner has one context only, so groups of any size end in suffix arrays of bounded size.

Equal texts are handled once: all windows of a text that occurs in several rows are repeats.

Defined cases: null counts as empty; texts shorter than ``length`` keep all bytes; repeated rows are repeats of each other;
overlapping repeats within one text count; an empty table gives no rows; extra columns are ignored by ``removed`` and kept by
``without_repeats``.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Bits, bounded_batches, boxed, drop_written, few, forget, map_rows, maybe, unboxed, written


@dataclass(frozen=True)
class Params:
    length: int = 400
    gram: int = 64
    more_grams: tuple[int, ...] = (328, 400)
    batch_bytes: int = 1 << 18
    group_bytes: int = 1 << 19


#: Texts are hashed in pieces of this many windows, since a window's place must fit in the low bits of its key.
PLACE_BITS = 20
PIECE = (1 << PLACE_BITS) - 4096
MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(multiplier ** i, its inverse ** i) mod 2**64 for i < n."""
    inverse = pow(MULTIPLIER, -1, 1 << 64)
    up, down = np.full(n, MULTIPLIER, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS: list[np.ndarray] = [*powers(1 << 12)]


def weighted_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the weighted bytes before each place, what takes a place's weight away again)."""
    n = len(data)
    if len(_POWERS[0]) < n + 1:
        _POWERS[:] = powers(1 << (n + 1).bit_length())
    up, down = _POWERS
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return sums, down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``gram`` bytes from each place."""
    sums, down = weighted_sums(data)
    return mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the bytes of each [start, end)."""
    sums, down = weighted_sums(data)
    return mixed((sums[ends] - sums[starts]) * down[starts])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by prefix and suffix minima of blocks."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def owners(data: np.ndarray, p: Params) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner hashes, first window, last window) of a text's windows, by pieces; places are within the text."""
    out = []
    for base in range(0, max(0, len(data) - p.length + 1), PIECE):
        part = data[base : base + PIECE + p.length - 1]
        out.append(owned(gram_hashes(part, p.gram), p.length - p.gram + 1, base))
    return out


def owned(h: np.ndarray, width: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner hashes, first window, last window) of windows of ``width`` grams, the first of them at ``base``."""
    mask = np.uint64((1 << PLACE_BITS) - 1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    own = (sliding_min(key, width) & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    last = np.append(first[1:] - 1, len(own) - 1)
    return h[own[first]].view(np.int64), first + base, last + base


def suffix_order(text: bytes, ends: np.ndarray, limit: int) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes; a suffix stops at its part's end (``ends`` of parts) or at ``limit``.

    Two stages: suffixes smaller than their successors (type B) are sorted directly, the rest (type A) are induced.
    """
    t, n = np.frombuffer(text, np.uint8), len(text)
    last = np.zeros(n, bool)
    last[ends - 1] = True
    following = np.empty(n, np.int16)
    following[:-1] = t[1:]
    following[last] = -1  # the end of a part is smaller than any byte
    change = np.flatnonzero(following != t)
    # a run of equal bytes has the type of its last place
    typed = following[change] > t[change]
    b_type = np.repeat(typed, np.diff(np.concatenate([[-1], change])))
    stop = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    direct = np.flatnonzero(b_type)
    shown = text.decode("latin-1")
    upto = np.minimum(direct + limit, stop[direct])
    keys = [shown[a:b] for a, b in zip(direct.tolist(), upto.tolist(), strict=True)]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)] if len(keys) else direct
    heads = np.concatenate([[0], np.cumsum(np.bincount(t[direct], minlength=256))])
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    first = np.zeros(n, bool)
    first[0] = True
    first[ends[:-1]] = True

    def push(places: np.ndarray, c: int) -> np.ndarray:
        """Deals the type A predecessors to their buckets; those of bucket c itself come back."""
        before = places[~first[places]] - 1
        before = before[~b_type[before]]
        if not len(before):
            return before
        chars = t[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        cuts = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]])).tolist()
        own = before[:0]
        for a, b in zip(cuts, [*cuts[1:], len(before)], strict=True):
            if chars[a] == c:
                own = before[a:b]
            else:
                pending[chars[a]].append(before[a:b])
        return own

    for c, places in enumerate(np.split(*by_char(t, ends - 1))):  # the empty suffixes induce the parts' last places
        if len(places) and not b_type[places[0]]:
            pending[c].append(places)
    out = []
    for c in range(256):
        part = np.concatenate(pending[c]) if pending[c] else direct[:0]
        while len(part):
            out.append(part)
            part = push(part, c)
        part = direct[heads[c] : heads[c + 1]]
        if len(part):
            out.append(part)
            push(part, c)
    return np.concatenate(out) if out else direct


def by_char(t: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    places = places[np.argsort(t[places], kind="stable")]
    return places, np.cumsum(np.bincount(t[places], minlength=256))[:-1]


def repeated_windows(contexts: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each context, the places of its windows that occur twice or more among all windows of all contexts."""
    ends = np.cumsum([len(c) for c in contexts])
    text = b"".join(contexts)
    order = suffix_order(text, ends, length)
    starts = np.concatenate([[0], ends[:-1]])
    which = np.searchsorted(ends, order, side="right")
    whole = order + length <= ends[which]
    order, which = order[whole], which[whole]
    # adjacent common prefixes: hashes leave out most pairs, the bytes decide
    h = gram_hashes(np.frombuffer(text, np.uint8), length)[order]
    near = np.flatnonzero(h[1:] == h[:-1])
    a, b = order[near].tolist(), order[near + 1].tolist()
    equal = np.zeros(len(order), bool)
    equal[near + 1] = [text[x : x + length] == text[y : y + length] for x, y in zip(a, b, strict=True)]
    cls = np.cumsum(~equal) - 1
    count = np.bincount(cls, np.array(weights)[which]) if len(cls) else np.zeros(0)
    found = count[cls] >= 2
    places, which = order[found] - starts[which[found]], which[found]
    by = np.lexsort((places, which))
    return np.split(places[by], np.searchsorted(which[by], np.arange(1, len(contexts))))


def spans_of(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Merged [start, end) of windows at ascending places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > length)
    return list(zip(places[np.append(0, cut + 1)].tolist(), (places[np.append(cut, len(places) - 1)] + length).tolist(), strict=True))


def sources(docs: DataFrame, text: str) -> DataFrame:
    """(sig, h, data): 128- and 64-bit hashes and bytes of each text, null as empty. Texts are told apart by sig; h only serves
    to find candidates."""
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(sig_of(data).alias("sig"), data.alias("data")).select("sig", F.xxhash64("sig").alias("h"), "data")


def sig_of(data):
    return F.unhex(F.md5(data))


def owner_rows(src: DataFrame, p: Params, find=owners, known: Bits | None = None) -> DataFrame:
    """(owner, h, place) of each distinct text of a batch; place is the owner's first window as ``find`` counts them. With
    ``known``, only owners that may be among those."""

    def make():
        forget()

        def work(batch: pa.RecordBatch):
            seen: set[int] = set()
            for text, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text in seen:
                    continue
                seen.add(text)
                for h, first, _ in find(np.frombuffer(raw.as_buffer(), np.uint8), p):
                    if known is not None:
                        some = known.there(h)
                        h, first = h[some], first[some]
                    yield pa.record_batch([pa.array(h), pa.array(np.full(len(h), text, np.int64)), pa.array(first.astype(np.int64))], ["owner", "h", "place"])

        return work

    long = src.where(F.length("data") >= p.length).select("h", "data")
    return map_rows(long, packed(make), "owner long, h long, place long")


def packed(make, rows: int = 20_000):
    """Joins the small batches that ``make()``'s function yields."""

    def joined():
        work = make()

        def run(batch: pa.RecordBatch):
            held, size = [], 0
            for out in work(batch):
                held.append(out)
                size += out.num_rows
                if size >= rows:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

        return run

    return joined


def repeated_owners(src: DataFrame, p: Params, find=owners) -> DataFrame:
    """(h, place) of owners whose hash occurs at two distinct (h, place). Counted before the shuffle; the places are found again
    by a filter of the repeated owners' bits, which may let others through. Where they are too many for the filter, a join
    leaves the others out; it splits owners of many places."""
    at = F.xxhash64("h", "place")
    counted = owner_rows(src, p, find).groupBy("owner").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a < b").select("owner")
    twice = written(counted, "repeated-owners")
    known = Bits(twice, "owner")
    rows = owner_rows(src, p, find, known)
    return written((rows.join(twice, "owner") if known.full else rows).select("h", "place"), "owners")


CONTEXTS = "owner long, name binary, item binary, start long, times long, context binary"


def context_rows(texts: DataFrame, p: Params) -> DataFrame:
    """Rows of CONTEXTS for (item, times, data, places): contexts of the owners at the places, of all owners where places is
    null. name is a 128-bit hash of the context; its bytes stand with the first row of a task that has that name."""

    def make():
        seen: set[bytes] = set()

        def work(batch: pa.RecordBatch):
            for item, times, raw, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                view = memoryview(raw.as_buffer())
                wanted = np.unique(places.values.to_numpy()) if places.is_valid else None
                for h, first, last in owners(np.frombuffer(view, np.uint8), p):
                    at = np.flatnonzero(np.isin(first, wanted)) if wanted is not None else np.arange(len(h))
                    if not len(at):
                        continue
                    names, some = [], []
                    for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True):
                        context = view[a : b + p.length]
                        name = xxhash.xxh3_128_digest(context)
                        if len(seen) > 200_000:
                            seen.clear()
                        some.append(None if name in seen else bytes(context))
                        seen.add(name)
                        names.append(name)
                    n = len(at)
                    cols = [pa.array(h[at]), pa.array(names, pa.binary()), pa.array([item] * n, pa.binary()), pa.array(first[at].astype(np.int64)), pa.array(np.full(n, times, np.int64)), pa.array(some, pa.binary())]
                    yield pa.record_batch(cols, ["owner", "name", "item", "start", "times", "context"])

        return work

    return map_rows(texts.select("item", "times", "data", "places"), packed(make, 4000), CONTEXTS)


def solved(cold: DataFrame, p: Params) -> DataFrame:
    """(name, first, last): repeated spans within each distinct context, from rows (owner, name, times, context) where the
    times of a name stand in a row of their own before its bytes."""

    def solve(found: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        names, first, upto = [], array("q"), array("q")
        windows = repeated_windows([c for _, _, c in found], [min(t, 2) for _, t, _ in found], p.length)
        for (name, _, _), places in zip(found, windows, strict=True):
            for a, b in spans_of(places, p.length):
                names.append(name)
                first.append(a)
                upto.append(b)
        return pa.record_batch([pa.array(names, pa.binary()), pa.array(first, pa.int64()), pa.array(upto, pa.int64())], ["name", "first", "last"])

    def run(batches):
        held, size, owner, name, times = [], 0, None, None, 0
        for batch in batches:
            for o, n, t, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if context is None:
                    if o != owner and size >= p.batch_bytes:
                        yield solve(held)
                        held, size = [], 0
                    owner, name, times = o, n, t
                elif n == name:
                    held.append((n, times, context))
                    size += len(context)
                    name = None  # once, whatever the number of tasks that sent it
        if held:
            yield solve(held)

    dealt = cold.repartition("owner").sortWithinPartitions("owner", "name", F.col("context").isNotNull())
    return dealt.select("owner", "name", "times", "context").mapInArrow(packed_stream(run), "name binary, first long, last long")


def spans_by_context(rows: DataFrame, p: Params, grams: tuple[int, ...]) -> DataFrame:
    """(item, first, last): the repeated spans of each item, from rows of CONTEXTS."""
    spark = rows.sparkSession
    counted = written(rows.groupBy("owner", "name").agg(F.sum("times").alias("times"), F.max(F.length("context")).alias("size")), "counted")
    large = counted.groupBy("owner").agg(F.sum("size").alias("size")).where(F.col("size") > p.group_bytes).select("owner") if grams else None
    bytes_ = rows.where("context is not null").select("owner", "name", F.lit(None).cast("long").alias("times"), "context")
    cold = counted.select("owner", "name", "times", F.lit(None).cast("binary").alias("context")).unionByName(bytes_)
    found = []
    if large is not None and (large := written(large, "large-owners")).head(1):
        kept_ = few(large)
        hot = bytes_.drop("times").join(kept_, "owner", "left_semi").dropDuplicates(["name"]).join(counted.select("name", "times"), "name")
        longer = replace(p, gram=grams[0])
        parts = hot.select(F.col("name").alias("item"), "times", F.col("context").alias("data"), F.lit(None).cast("array<long>").alias("places"))
        sub = written(context_rows(parts, longer), "contexts")
        found.append(spans_by_context(sub, longer, grams[1:]).withColumnRenamed("item", "name"))
        cold = cold.join(kept_, "owner", "left_anti")
    found.append(solved(cold, p))
    within = written(reduce(DataFrame.unionByName, found), "found")
    out = written(rows.select("name", "item", "start").join(within, "name").select("item", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")), "spans")
    drop_written(spark, rows, counted, within)
    return out


def packed_stream(run, rows: int = 20_000):
    def joined(batches):
        held, size = [], 0
        for out in run(batches):
            held.append(out)
            size += out.num_rows
            if size >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def texts_with(src: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """(item, times, data, places) of the distinct texts that have places; the filter leaves most texts out before the join."""
    listed = places.groupBy("h").agg(F.collect_set("place").alias("places"))  # at most as many as the text has words
    some = src.where(F.length("data") >= least).where(maybe(places, "h")(F.col("h")))
    distinct = some.groupBy("sig").agg(F.first("h").alias("h"), F.first("data").alias("data"))
    return distinct.join(listed, "h").select(F.col("sig").alias("item"), F.lit(1).cast("long").alias("times"), "data", "places")


def repeated_spans(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """(sig, firsts, lasts): for each text with repeats its spans as arrays, unmerged."""
    spark = bounded_batches(docs.sparkSession, 500)
    src = sources(docs, text)
    places = repeated_owners(src, p)
    contexts = written(context_rows(texts_with(src, places, p.length), p), "contexts")
    spans = spans_by_context(contexts, p, p.more_grams).withColumnRenamed("item", "sig")
    bounded_batches(spark)
    every = spans.unionByName(copies(src, p.length).select("sig", F.lit(0).cast("long").alias("first"), "last"))
    out = written(every.groupBy("sig", "first").agg(F.max("last").alias("last")).groupBy("sig").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")), "repeats")
    drop_written(spark, places, spans)
    return out


def copies(src: DataFrame, least: int) -> DataFrame:
    """(sig, last) of texts that stand in several rows, with their length."""
    return src.where(F.length("data") >= least).groupBy("sig").agg(F.count("*").alias("n"), F.max(F.length("data")).cast("long").alias("last")).where("n >= 2").select("sig", "last")


def cut(data: bytes, firsts: np.ndarray, lasts: np.ndarray) -> tuple[bytes, int, int]:
    """(bytes kept, bytes removed, maximal removed runs)."""
    order = np.argsort(firsts, kind="stable")
    firsts, reach = firsts[order], np.maximum.accumulate(lasts[order])
    new = np.concatenate([[True], firsts[1:] > reach[:-1]])
    starts = firsts[new]
    ends = reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
    kept, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), int((ends - starts).sum()), len(starts)


def removed(docs: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spans = repeated_spans(docs, p, text)
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    hit = maybe(spans.select(F.xxhash64("sig").alias("h")), "h")(F.xxhash64("sig"))
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), sig_of(data).alias("sig"), data.alias("data")).withColumn("hit", hit)
    zero = F.lit(0).cast("long")
    whole = src.where("not hit").select("doc_id", F.length("data").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"))

    def make():
        def work(batch: pa.RecordBatch):
            rows = []
            for i, raw, firsts, lasts in zip(*(batch.column(k) for k in range(4)), strict=True):
                raw = raw.as_py()
                kept_, n, runs = cut(raw, firsts.values.to_numpy(), lasts.values.to_numpy()) if firsts.is_valid else (raw, 0, 0)
                rows.append((i.as_py(), len(raw), n, runs, hashlib.sha256(kept_).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return work

    some = map_rows(src.where("hit").join(spans, "sig", "left").select("doc_id", "data", "firsts", "lasts"), make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return whole.unionByName(some)


def without_repeats(docs: DataFrame, p: Params = Params(), text: str = "text", more: DataFrame | None = None) -> DataFrame:
    """The documents, all columns kept, with repeats cut out of the text; characters cut in two go as a whole.

    ``more`` has further spans to cut, as ``repeated_spans`` gives them.
    """
    spans = repeated_spans(docs, p, text)
    if more is not None:
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("firsts", "lasts")]
        spans = written(spans.unionByName(more).groupBy("sig").agg(*lists), "spans-to-cut")
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")

    @F.arrow_udf("string")
    def rest(raw: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        return pa.array([cut(d.as_py(), a.values.to_numpy(), b.values.to_numpy())[0].decode("utf-8", "ignore") for d, a, b in zip(raw, firsts, lasts, strict=True)], pa.string())

    rows = boxed(docs, data=data, sig=sig_of(data))
    marked = rows.withColumn("hit", maybe(spans.select(F.xxhash64("sig").alias("h")), "h")(F.xxhash64("sig")))
    joined = marked.where("hit").join(spans.select("sig", "firsts", "lasts"), "sig", "left")
    as_is = marked.where("not hit").select("row").unionByName(joined.where("firsts is null").select("row"))
    return unboxed(as_is, docs).unionByName(unboxed(joined.where("firsts is not null"), docs, **{text: rest(F.col("data"), F.col("firsts"), F.col("lasts"))}))
