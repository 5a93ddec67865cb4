"""N-gram Jaccard join by a token-group matrix (operator 9).

A document's set holds 64-bit hashes of its distinct word shingles; equal sets (by a 128-bit hash) are one node. One pass over
the texts writes the sets; everything after it works on that table.

1. Loners. A linked set has ``ceil(n * num / den)`` tokens in common with its partner, so all of these stand in two sets at
   least. Tokens are dealt by range, as ``short_bits`` sorted bits each with the number of the set in its window, and come back as
   the numbers of sets whose tokens stand elsewhere; sets with too few of them link with nothing and go no further. (Tokens that
   are taken for one another by chance let a set through, they leave none out.)
2. Prefixes. The tokens of what is left are counted over all of it and ordered by that count, then by hash: any order that all sets share serves, a rare-first one names the fewest candidates. Linked sets share one of the first
   ``n - ceil(n * num / den) + 1`` tokens of each. Only (token, size class, set) travels. Sets of sizes that allow a link which
   share such keys, directly or by others, get one label.
3. Groups. Labels of more sets than a group holds are salted; sorted by label and salt, sets are cut into groups of bounded size.
   A group is stored as its token union and, for each set, the columns it has there.
4. Each group is opened on itself: the matrix times its transpose has all intersections. Links go to a spanning forest.
   Families larger than a group are dealt to groups once more in another way, which merges most of what is left of them.
5. Labels that stand in several groups and components name queries for other groups. There, and only there, sets are compared
   by parity sketches: bits that each of a set's tokens flips, so that two sets differ in at least as many tokens as their
   sketches in bits. A set is sent once for its label (a label of very many sets is gone through key by key), to sets of sizes
   that allow a link; sketches have a largest size, so that long texts cost no more than others.
6. In the group, the overlap of the query with the token union bounds every intersection; only groups whose bound reaches the
   threshold are opened.

The result needs components, not all links, so pairs within a component are not looked at again: no link between different
components is lost, and large families of copies cost their size, not its square.

Defined cases: null or empty texts and texts without words have no shingles and link with nothing; fewer words than a
shingle count as one; rows with equal sets are one node whatever their number; a null id is a row of its own set like any
other, but never names a component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_batches, drop_written, few, forget, map_column, map_rows, maybe, written
from siltstone.llm.components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


@dataclass(frozen=True)
class Params:
    size: int = 3  # words of a shingle
    num: int = 90  # linked when den * intersection >= num * union
    den: int = 100
    group_rows: int = 256
    group_tokens: int = 65_536
    window_tokens: int = 1 << 20  # tokens of a window; it has no more sets than 16 bits can tell apart
    part_tokens: int = 1 << 20  # tokens of a range that one task counts
    short_bits: int = 27  # of a token in its range: at part_tokens one in a hundred is taken for another
    order_tokens: int = 1 << 20
    sketch_most: int = 8192
    label_sets: int = 1 << 16  # sets of a label that are compared as one
    block_rows: int = 2048  # sets of one key that are compared by sketches at once
    group_queries: int = 1024  # queries that one opening of a group serves

    def prefix(self, n):
        return n + 1 - -(-n * self.num // self.den)

    def sketch_bits(self, n: int) -> int:
        return min(self.sketch_most, max(256, 1 << (32 * n * (self.den - self.num) // (self.den + self.num)).bit_length()))

    def least(self, n):
        """Tokens that a set of n has in common with any set it links with."""
        return -(-n * self.num // self.den)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * ODD[3]
    h = (h ^ (h >> np.uint64(27))) * ODD[4]
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; words are parted by ASCII white space, A-Z lower-cased."""
    words = [t.encode().translate(LOWER).split() if t else [] for t in texts]
    ends = np.cumsum([len(w) for w in words]).tolist()
    h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, ends[-1] if ends else 0)
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        out = mix(out * ODD[0] + h[i : i + len(out)] + ODD[1])
    sets, at = [], 0
    for end in ends:
        if end - at >= size:
            s = np.sort(out[at : end - size + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            sets.append(s[keep])
        elif end > at:
            s = np.zeros(1, np.uint64)
            for i in range(at, end):
                s = mix(s * ODD[0] + h[i] + ODD[1])
            sets.append(s)
        else:
            sets.append(out[:0])
        at = end
    return sets


def signature(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes(), seed=len(s))


def texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def signatures(p: Params):
    """A column function: the sig of each text as ``set_rows`` has it."""

    def make():
        def work(texts: list) -> pa.Array:
            return pa.array([signature(s) if len(s) else None for s in shingle_sets(texts, p.size)], pa.binary())

        return work

    return map_column(make, "binary")


SETS = "doc_id long, n long, sig binary, tokens binary, win long, at int"


def set_rows(src: DataFrame, p: Params) -> DataFrame:
    """A row (doc_id, n, sig, tokens, win, at) for each text; tokens, and the set's window and number there, are null where the task
    has given that set before."""
    from pyspark import TaskContext

    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32())
    names = ["doc_id", "n", "sig", "tokens", "win", "at"]

    def run(batches):
        forget()
        win, sets, held, seen = TaskContext.get().partitionId() << 32, 0, 0, set()
        for batch in batches:
            for part in range(0, batch.num_rows, 128):
                some = batch.slice(part, 128)
                rows = []
                for s in shingle_sets(some.column(1).to_pylist(), p.size):
                    row = (len(s), signature(s) if len(s) else None, None, None, None)
                    if len(s) and row[1] not in seen:
                        if len(seen) >= 100_000:
                            seen.clear()
                        seen.add(row[1])
                        if held >= p.window_tokens or sets == 1 << 16:
                            win, sets, held = win + 1, 0, 0
                        row = (*row[:2], s.tobytes(), win, sets)
                        sets, held = sets + 1, held + len(s)
                    rows.append(row)
                cols = zip(*rows, strict=True)
                yield pa.record_batch([some.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return src.mapInArrow(run, SETS)


def packed(values: np.ndarray) -> bytes:
    """Numbers by planes of equal bytes, compressed."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def unpacked(blob: bytes, kind) -> np.ndarray:
    planes, wide = np.frombuffer(zstandard.decompress(blob), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(wide, len(planes) // wide).T).view(kind).ravel()


def not_alone(every: DataFrame, p: Params) -> DataFrame:
    """(node, win, at) of the sets that have enough tokens which stand in other sets too, each set once."""
    sets = every.where("tokens is not null")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(0, (total // p.part_tokens).bit_length())

    def dealt(batches):
        now, held, size = None, [], 0

        def sent():
            token = np.concatenate([s for _, s in held])
            owner = np.repeat(np.array([at for at, _ in held], np.uint16), [len(s) for _, s in held])
            order = np.argsort(token)
            token, owner = token[order], owner[order]
            ends = [0, *np.searchsorted(token, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits if bits else 0)).tolist(), len(token)]
            short = ((token << np.uint64(bits)) >> np.uint64(64 - p.short_bits)).astype(np.uint32)
            for part in range(1 << bits):
                a, b = ends[part], ends[part + 1]
                if a < b:
                    cols = ([part], [now], [packed(np.diff(short[a:b], prepend=np.uint32(0)))], [packed(owner[a:b])])
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "win", "gaps", "owners"])

        for batch in batches:
            for win, at, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (win != now or size >= p.window_tokens):
                    yield from sent()
                    held, size = [], 0
                s = np.frombuffer(blob, np.uint64)
                now, size = win, size + len(s)
                held.append((at, s))
        if held:
            yield from sent()

    def elsewhere(rows: pa.Table) -> pa.Table:
        wins, short, owners = rows.column("win"), [], []
        for gaps, own in zip(rows.column("gaps").to_pylist(), rows.column("owners").to_pylist(), strict=True):
            short.append(np.cumsum(unpacked(gaps, np.uint32), dtype=np.uint32))
            owners.append(unpacked(own, np.uint16))
        every_ = np.concatenate(short)
        order = np.argsort(every_, kind="stable")
        same = np.diff(every_[order]) == 0
        shared = np.zeros(len(every_), bool)
        shared[order] = np.r_[same, False] | np.r_[False, same]
        out, at = [], 0
        for own in owners:
            out.append(packed(own[shared[at : at + len(own)]]))
            at += len(own)
        return pa.table({"win": wins, "owners": pa.array(out, pa.binary())})

    def left(sets_: pa.Table, found: pa.Table) -> pa.Table:
        at, n = sets_.column("at").to_numpy(), sets_.column("n").to_numpy()
        times = np.zeros(1 << 16, np.int64)
        for blob in found.column("owners").to_pylist():
            times += np.bincount(unpacked(blob, np.uint16), minlength=1 << 16)
        return sets_.select(["sig", "win", "at"]).filter(pa.array(times[at] >= p.least(n)))

    rows = sets.select("win", "at", "tokens").mapInArrow(dealt, "part long, win long, gaps binary, owners binary")
    found = rows.groupBy("part").applyInArrow(elsewhere, "win long, owners binary")
    named = sets.select("win", "at", "n", "sig")
    left_ = named.groupBy("win").cogroup(found.groupBy("win")).applyInArrow(left, "sig binary, win long, at int")
    return left_.groupBy("sig").agg(F.min(F.struct("win", "at")).alias("x")).select(node_of("sig").alias("node"), "x.win", "x.at")


def token_order(sets: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(sorted frequent tokens, their counts): at most ``order_tokens``, the most frequent."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                token, times = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64), return_counts=True)
                yield pa.record_batch([pa.array(token), pa.array(times)], ["token", "times"])

    counted = sets.select("tokens").mapInArrow(run, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    counted = written(counted.where("times > 1"), "frequent")
    by_size = counted.groupBy(F.floor(F.log2("times") * 4).cast("int").alias("size")).count().collect()  # a few hundred rows
    least, total = 0, 0
    for size, n in sorted(map(tuple, by_size), reverse=True):
        total += n
        if total > p.order_tokens:
            least = size + 1
            break
    got = counted.where(F.floor(F.log2("times") * 4) >= least).toArrow()
    drop_written(sets.sparkSession, counted)
    token, times = (got.column(i).to_numpy().astype(np.uint64) for i in (0, 1))
    by = np.argsort(token)
    return token[by], times[by]


def prefixes(sets: list[np.ndarray], order: tuple[np.ndarray, np.ndarray], p: Params) -> list[np.ndarray]:
    """The keys of each set: its first tokens by (count, hash)."""
    token, times = order
    every = np.concatenate(sets)
    weight = np.zeros(len(every), np.uint64)
    if len(token):
        at = np.minimum(np.searchsorted(token, every), len(token) - 1)
        weight = np.where(token[at] == every, times[at], weight)
    out, start = [], 0
    for s in sets:
        w = weight[start : start + len(s)]
        k = p.prefix(len(s))
        out.append(s[np.sort(np.argsort(w, kind="stable")[:k])] if w.any() else s[:k])
        start += len(s)
    return out


def size_class(n, p: Params):
    """A class spans the ratio of linked sizes, so sets that link are of one class or of two neighbouring ones."""
    return F.floor(F.log(n) / F.lit(float(np.log(p.den / p.num) * (1 + 1e-9)))).cast("int")


def key_rows(sets: DataFrame, order, p: Params) -> DataFrame:
    """(key, class, node, low) for each set (node, tokens), its class and the one below, and each of its keys that another set has
    there; low is the least node there. Sets of sizes that allow a link meet in a class."""

    def make():
        def work(batch: pa.RecordBatch):
            for part in range(0, batch.num_rows, 64):
                some = batch.slice(part, 64)
                every = [np.frombuffer(b, np.uint64) for b in some.column(1).to_pylist()]
                keys = prefixes(every, order.value, p)
                lens = [len(k) for k in keys]
                cols = [np.concatenate(keys).view(np.int64), np.repeat(some.column(0).to_numpy(), lens), np.repeat([len(s) for s in every], lens)]
                yield pa.record_batch([pa.array(c) for c in cols], ["key", "node", "n"])

        return work

    rows = map_rows(sets.select("node", "tokens"), make, "key long, node long, n long").withColumn("own", size_class(F.col("n"), p))
    rows = rows.select("key", "node", F.explode(F.array("own", F.col("own") - 1)).alias("class"))
    by_key = Window.partitionBy("key", "class")
    placed_ = rows.withColumn("low", F.min("node").over(by_key)).withColumn("high", F.max("node").over(by_key))
    return placed_.where("low < high").drop("high")


def sketch(s: np.ndarray, bits: int) -> bytes:
    """A bit for each token's remainder, flipped by every token that has it."""
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_rows(sets: DataFrame, shared: DataFrame, order, p: Params) -> DataFrame:
    """(key, node, n, sketch) of the sets at their shared keys; a filter may let through keys of a single set.

    Partners are sought by node, so that rows are short. Sets of one node would have to meet at one key to be taken for one
    another here; beyond this step sets are told apart by sig.
    """
    bits = Bits(shared, "key")

    def make():
        may = bits.there

        def work(batch: pa.RecordBatch):
            for nodes, keys, sets_ in keyed(batch, order.value, p):
                lens = [len(k) for k in keys]
                every = np.concatenate(keys)
                hit = np.flatnonzero(may(every))
                row = np.repeat(np.arange(len(nodes)), lens)[hit]
                some = set(row.tolist())
                sketches = [sketch(s, p.sketch_bits(len(s))) if i in some else b"" for i, s in enumerate(sets_)]
                cols = [pa.array(every[hit].view(np.int64)), pa.array(nodes[row]), pa.array(np.array([len(s) for s in sets_], np.int64)[row]), pa.array(sketches, pa.binary()).take(pa.array(row))]
                yield pa.record_batch(cols, ["key", "node", "n", "sketch"])

        return work

    return map_rows(sets.where("tokens is not null").select("sig", "tokens"), make, "key long, node long, n long, sketch binary")


def sketches(sets: DataFrame, p: Params) -> DataFrame:
    """(sig, n, sketch) from (sig, tokens)."""

    def make():
        def work(batch: pa.RecordBatch):
            every = [np.frombuffer(b, np.uint64) for b in batch.column(1).to_pylist()]
            cols = [pa.array([len(s) for s in every], pa.int64()), pa.array([sketch(s, p.sketch_bits(len(s))) for s in every], pa.binary())]
            yield pa.record_batch([batch.column(0), *cols], ["sig", "n", "sketch"])

        return work

    return map_rows(sets.select("sig", "tokens"), make, "sig binary, n long, sketch binary")


def near_pairs(n: np.ndarray, blobs: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs whose sizes and sketches allow a link. Linked sets differ in at most (n + m)(den - num) / (den + num)
    tokens; a sketch is folded to the size of a smaller one."""
    words = np.array([len(b) // 8 for b in blobs])
    left, right = [], []
    for small in np.unique(words).tolist():
        for large in (x for x in np.unique(words).tolist() if x >= small):
            a, b = np.flatnonzero(words == small), np.flatnonzero(words == large)
            one, two = (np.frombuffer(b"".join([blobs[i] for i in at]), np.uint64).reshape(len(at), -1) for at in (a, b))
            two = np.bitwise_xor.reduce(two.reshape(len(b), large // small, small), 1)
            for k in range(len(a)):
                rest = np.flatnonzero(b > a[k]) if small == large else np.arange(len(b))
                m, size = n[b[rest]], n[a[k]]
                rest = rest[p.den * np.minimum(m, size) >= p.num * np.maximum(m, size)]
                apart = np.bitwise_count(two[rest] ^ one[k]).sum(1, dtype=np.int64)
                near = b[rest[apart * (p.den + p.num) <= (n[b[rest]] + size) * (p.den - p.num)]]
                left.append(np.full(len(near), a[k]))
                right.append(near)
    return np.concatenate(left), np.concatenate(right)


def by_block(rows: DataFrame, p: Params) -> DataFrame:
    """The rows (key, n, ...) with their size's class, x and y, such that any two sets of a key whose sizes allow a link meet. A set
    is dealt to its own class and the one below. A key with many sets of a class is dealt
    by pairs of blocks, so that no task holds more than two blocks of it."""
    dealt = rows.withColumn("own", size_class(F.col("n"), p)).withColumn("class", F.explode(F.array("own", F.col("own") - 1)))
    large = dealt.groupBy("key", "class").agg(F.ceil(F.count("*") / p.block_rows).alias("blocks")).where("blocks > 1")
    block = F.pmod(F.xxhash64("sig"), F.coalesce("blocks", F.lit(1)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))
    dealt = dealt.join(few(large), ["key", "class"], "left").withColumn("block", block).withColumn("other", other)
    dealt = dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("block", "other", "blocks")
    return dealt.repartition("key", "class", "x", "y").sortWithinPartitions("key", "class", "x", "y")


def by_key(look, names: list[str], kinds: tuple):
    """A function over sorted batches (key, class, x, y, ...): ``look`` turns the rows of a key into tuples of the named columns."""

    def run(batches):
        now, held, out = None, [], set()
        for batch in batches:
            for *place, own, row in zip(*(c.to_pylist() for c in batch.columns[:5]), zip(*(c.to_pylist() for c in batch.columns[5:]), strict=True), strict=True):
                if place != now:
                    if len(held) > 1:
                        out.update(look(held))
                    now, held = place, []
                held.append((own, *row))
            if len(out) > 100_000:
                yield made(out)
                out = set()
        out.update(look(held) if len(held) > 1 else ())
        yield made(out)

    def made(found) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [()] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def grouped(sets: DataFrame, p: Params, seed: int = 0) -> DataFrame:
    """Rows (grp, sigs, lens, columns, tokens): sets sorted by label, cut into groups of bounded rows and tokens; tokens is the
    group's union, columns the places of each set's tokens there."""
    from pyspark import TaskContext

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        sigs, blobs, size, last = [], [], 0, None

        def done() -> pa.RecordBatch:
            lens = np.array([len(b) // 8 for b in blobs], "<i8")
            union, column = np.unique(np.frombuffer(b"".join(blobs), np.uint64), return_inverse=True)
            cols = [pa.array([(part << 32) + made], pa.int64()), pa.array([sigs], pa.list_(pa.binary()))]
            return pa.record_batch(cols + [pa.array([x], pa.binary()) for x in (lens.tobytes(), column.astype("<i4").tobytes(), union.tobytes())], ["grp", "sigs", "lens", "columns", "tokens"])

        for batch in batches:
            for sig, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sig == last:  # the same set from another task
                    continue
                last = sig
                if sigs and (len(sigs) >= p.group_rows or size + len(blob) // 8 > p.group_tokens):
                    yield done()
                    sigs, blobs, size, made = [], [], 0, made + 1
                sigs.append(sig)
                blobs.append(blob)
                size += len(blob) // 8
        if sigs:
            yield done()

    dealt = salted(sets, p, seed).repartition("label", "salt").sortWithinPartitions("label", "salt", "sig").select("sig", "tokens")
    return written(dealt.mapInArrow(run, "grp long, sigs array<binary>, lens binary, columns binary, tokens binary"), "groups")


def salted(sets: DataFrame, p: Params, seed: int) -> DataFrame:
    """(sig, tokens, label, salt): a label with more sets than a group's rows is dealt over as many salts as groups."""
    large = sets.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > p.group_rows)
    salts = F.ceil(F.coalesce("n", F.lit(1)) / p.group_rows)
    return sets.join(few(large), "label", "left").select("sig", "tokens", "label", F.pmod(F.xxhash64("sig", F.lit(seed)), salts).alias("salt"))


def open_group(sigs: list[bytes], sizes: np.ndarray, columns: np.ndarray, p: Params) -> list[tuple[bytes, bytes]]:
    """Links within a group, to a spanning forest: (least node of the part, other node)."""
    shared = np.bincount(columns) > 1  # tokens of one set alone add to no intersection
    row, used = np.repeat(np.arange(len(sigs)), sizes), shared[columns]
    matrix = np.zeros((len(sigs), int(shared.sum())), np.float32)
    matrix[row[used], (np.cumsum(shared) - 1)[columns[used]]] = 1
    common = np.rint(matrix @ matrix.T).astype(np.int64)
    linked = p.den * common >= p.num * (sizes[:, None] + sizes[None, :] - common)
    return forest(sigs, *np.nonzero(np.triu(linked, 1)))


def forest(sigs: list[bytes], left, right) -> list[tuple[bytes, bytes]]:
    root = list(range(len(sigs)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(sigs[find(i)], sigs[i]) for i in range(len(sigs)) if find(i) != i]


def link_batch(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])


def links_within(groups: DataFrame, p: Params) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch):
            links: list[tuple[bytes, bytes]] = []
            for sigs, lens, columns in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if len(sigs) > 1:
                    links += open_group(sigs, np.frombuffer(lens, "<i8"), np.frombuffer(columns, "<i4"), p)
            yield link_batch(links)

        return work

    return map_rows(groups.select("sigs", "lens", "columns"), make, "a binary, b binary")


def members(groups: DataFrame) -> DataFrame:
    """(sig, grp) of each set of each group."""
    return groups.select(F.explode("sigs").alias("sig"), "grp")


def node_of(sig):
    return F.conv(F.hex(F.substring(sig, 1, 8)), 16, -10).cast("long")


def candidates(member: DataFrame, keys: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """(sig, comp, grp): queries and the groups they are sent to, from labels that hold several groups and components."""
    several = [F.min("grp").alias("g0"), F.max("grp").alias("g1"), F.min("comp").alias("c0"), F.max("comp").alias("c1")]
    named = member.join(sets.select("sig", "label"), "sig")
    mixed = named.groupBy("label").agg(F.count("*").alias("sets"), *several).where("g0 <> g1 and c0 <> c1").select("label", "sets")
    open_ = written(named.join(few(mixed), "label"), "mixed-labels")
    small = open_.where(F.col("sets") <= p.label_sets).select(F.xxhash64("label").alias("key"), "sig", "grp", "comp")
    large = keys.select("key", "node").distinct().join(few(open_.where(F.col("sets") > p.label_sets)), F.col("node") == F.col("own")).select("key", "sig", "grp", "comp")
    mixed = large.groupBy("key").agg(*several).where("g0 <> g1 and c0 <> c1").select("key")
    met = small.unionByName(large.join(mixed, "key"))
    sent = sketches(sets.join(few(open_.select("sig").distinct()), "sig", "left_semi"), p)

    def look(held: list[tuple]):
        own, sigs, grps, comps, n, blobs = zip(*held, strict=True)
        bucket = min(own)  # a set stands in its own class or in the one below
        for i, j in zip(*(x.tolist() for x in near_pairs(np.array(n), list(blobs), p)), strict=True):
            if grps[i] != grps[j] and comps[i] != comps[j] and (own[i] == bucket or own[j] == bucket):
                one, two = (i, j) if grps[i] < grps[j] else (j, i)
                yield sigs[one], comps[one], grps[two]

    rows = by_block(met.join(sent, "sig"), p).select("key", "class", "x", "y", "own", "sig", "grp", "comp", "n", "sketch")
    return rows.mapInArrow(by_key(look, ["sig", "comp", "grp"], (pa.binary(), pa.binary(), pa.int64())), "sig binary, comp binary, grp long").distinct()


def links_between(groups: DataFrame, sets: DataFrame, keys: DataFrame, roots: DataFrame, p: Params) -> DataFrame:
    """Links between different components: queries meet the groups they are sent to."""
    member = written(members(groups).join(roots, F.col("sig") == F.col("node"), "left").select("sig", "grp", F.coalesce("root", "sig").alias("comp")).withColumn("own", node_of("sig")), "members")
    wanted = written(candidates(member, keys, sets, p), "candidates")
    # large groups of queries are dealt over salts, the group goes to each of them
    salts = wanted.groupBy("grp").agg(F.ceil(F.count("*") / p.group_queries).alias("salts"))
    queries = wanted.join(salts, "grp").withColumn("salt", F.pmod(F.xxhash64("sig"), "salts")).select("grp", "salt", "sig", "comp")
    asked_sets = sets.join(few(wanted.select("sig").distinct()), "sig", "left_semi").select("sig", "tokens")
    every_salt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    own = member.join(few(salts), "grp").select("grp", every_salt, "sig", "comp", F.lit(None).cast("binary").alias("tokens"))  # the group's sets
    queries = queries.join(asked_sets, "sig").select("grp", "salt", "sig", "comp", "tokens").unionByName(own).groupBy("grp", "salt")
    opened = groups.join(few(salts), "grp").select("grp", every_salt, "sigs", "lens", "columns", "tokens")

    def run(asked: pa.Table, group: pa.Table) -> pa.Table:
        links: list[tuple[bytes, bytes]] = []
        if asked.num_rows and group.num_rows:
            row = group.slice(0, 1).to_pylist()[0]
            query = list(zip(*(asked.column(c).to_pylist() for c in ("sig", "comp", "tokens")), strict=True))
            comp = {sig: c for sig, c, tokens in query if tokens is None}
            query = [x for x in query if x[2] is not None]
            links = open_for(query, row["sigs"], [comp[s] for s in row["sigs"]], np.frombuffer(row["lens"], "<i8"), np.frombuffer(row["columns"], "<i4"), np.frombuffer(row["tokens"], np.uint64), p)
        return pa.Table.from_batches([link_batch(links)])

    return queries.cogroup(opened.groupBy("grp", "salt")).applyInArrow(run, "a binary, b binary")


def open_for(queries, sigs: list[bytes], comps: list[bytes], sizes: np.ndarray, columns: np.ndarray, union: np.ndarray, p: Params) -> list[tuple[bytes, bytes]]:
    """Links of queries (sig, comp, tokens) with a group's sets of other components; the bound by the union chooses the queries
    that open the group."""
    matrix, out, met, comp_ = None, [], set(), np.array(comps, object)
    for sig, comp, blob in queries:
        s = np.frombuffer(blob, np.uint64)
        at = np.minimum(np.searchsorted(union, s), len(union) - 1)
        at = at[union[at] == s]
        if p.den * len(at) < p.num * len(s):  # no set of the group can reach the threshold
            continue
        if matrix is None:
            matrix = np.zeros((len(sigs), len(union)), np.uint8)
            matrix[np.repeat(np.arange(len(sigs)), sizes), columns] = 1
        common = matrix[:, at].sum(1, dtype=np.int64)
        for k in np.flatnonzero((p.den * common >= p.num * (len(s) + sizes - common)) & (comp_ != comp)).tolist():
            if (comp, comps[k]) not in met:  # one link joins two components
                met.add((comp, comps[k]))
                out.append((sig, sigs[k]))
    return out


def join(docs: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    return placed(docs, params, doc_id, text).select("doc_id", "n_shingles", "component_id")


def placed(docs: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``join`` with sig (the row's set, null without shingles) and root (its component, also where rows of other
    components have the same ids)."""
    p, spark = params, bounded_batches(docs.sparkSession)
    every = written(set_rows(texts(docs, doc_id, text), p), "sets")
    nodes = written(every.select("doc_id", "n", "sig"), "nodes")
    left = written(not_alone(every, p), "not-alone")
    whole = every.where("tokens is not null").withColumn("node", node_of("sig"))
    rest = written(whole.where(maybe(left, "node")("node")).join(few(left.select("win", "at")), ["win", "at"], "left_semi").select("node", "sig", "tokens"), "rest")
    drop_written(spark, every)
    order = spark.sparkContext.broadcast(token_order(rest, p))
    keys = written(key_rows(rest, order, p), "keys")
    labels = components(keys.select(F.col("low").alias("a"), F.col("node").alias("b")).where("a <> b").distinct())
    sets = written(rest.join(few(labels.withColumnRenamed("root", "label")), "node").select("sig", "tokens", "label"), "labelled")
    drop_written(spark, rest, left)
    groups = grouped(sets, p)
    bounded_batches(spark, 64)  # a row is a group
    first = written(links_within(groups, p), "within")
    roots = components(first)
    # labels of more sets than a group holds are dealt once more in another way, unless they are one component by now
    placed_ = sets.join(roots, F.col("sig") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sig"))
    mixed = placed_.groupBy("label").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where((F.col("n") > p.group_rows) & (F.col("lo") != F.col("hi"))).select("label")
    second = written(links_within(grouped(sets.join(few(written(mixed, "mixed")), "label", "left_semi"), p, 1), p), "again")
    roots = components(first.unionByName(second))
    third = written(links_between(groups, sets, keys, roots, p), "between")
    roots = components(first.unionByName(second).unionByName(third))
    bounded_batches(spark)
    drop_written(spark, keys, labels, sets, groups, first, second, third)
    least = nodes.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    named = least.join(roots, F.col("sig") == F.col("node"), "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sig", "root", "component_id")
    return nodes.join(named, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "sig", "root")
