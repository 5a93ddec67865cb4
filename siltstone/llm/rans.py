"""Token ids in a file format of static range asymmetric numeral systems (operator 5).

Layout of a file (all integers little-endian)::

    "SRAN" | version u16 | lanes u16 | table id u64 | documents u32 | tokens u64 | blocks u32
    blocks * (tokens u32 | payload bytes u32 | crc32 of payload u32)              checkpoints: each block starts afresh
    documents * (doc_id i64 | tokens u32)
    payloads

A payload holds one block of up to ``BLOCK`` ids: ``lanes`` final states (u64), then the 32-bit words in decoding order.
Blocks are independent, so any block can be decoded alone and in parallel. Id i of a block belongs to lane i % lanes; the
lanes run interleaved, so one step codes ``lanes`` ids with vector operations. The frequency table, shared by all files, is
quantized to 2**SCALE and named by its crc in each file.

Files are rows (file_no, data) of a written table in the shared folder, since executors share only what Spark writes.
Documents are dealt to files by ranges of doc_id, ascending, so files in order hold all documents in order.

Defined cases: a null or empty text holds only the end id; rows with equal doc_id follow each other in order of
their texts; a null doc_id sorts first (before every other); an empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Cache, bounded_batches, drop_written, few, kept, written

#: Fixed values of the format.
MAGIC, VERSION, LANES, BLOCK, SCALE = b"SRAN", 1, 2048, 1 << 19, 20
HEAD = struct.Struct("<4sHHQIQI")
LOW = 1 << 31
INDEX = np.dtype([("doc", "<i8"), ("n", "<u4")])
NO_ID = -(1 << 63)
#: Rows and ids after which a range of doc_ids begins a further file, and how many ranges there are at most.
FILE_ROWS, FILE_IDS, RANGES = 4000, 1 << 22, 1 << 14
#: The pre-tokenizer whose rules ``Pieces`` knows: its words hold letters alone, a digit alone, or what is neither nor blank.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Bytes of texts that are split at once, and words that a generation of the memo holds.
SLICE, MEMO = 8 << 20, 400_000


class Tables:
    """Frequencies quantized to 2**SCALE (every id of the vocabulary gets at least 1), their sums and the slot lookup."""

    def __init__(self, counts: np.ndarray):
        total, size = 1 << SCALE, len(counts)
        share = counts.astype(np.float64) / max(1, counts.sum())
        freq = 1 + np.floor(share * (total - size)).astype(np.int64)
        freq[int(freq.argmax())] += total - int(freq.sum())
        self._fill(freq)

    def _fill(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.crc = zlib.crc32(self.freq.tobytes())
        self._slots: np.ndarray | None = None

    @classmethod
    def of(cls, freq: np.ndarray) -> Tables:
        """The tables of frequencies that are quantized already."""
        new = cls.__new__(cls)
        new._fill(freq)
        return new

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, t: Tables) -> bytes:
    """Lanes are coded from the last id to the first, so that decoding goes forwards."""
    n = len(ids)
    steps = -(-n // LANES)
    freq, start = np.ones(steps * LANES, np.uint64), np.zeros(steps * LANES, np.uint64)
    freq[:n], start[:n] = t.freq[ids], t.start[ids]
    freq, start = freq.reshape(steps, LANES), start.reshape(steps, LANES)
    state = np.full(LANES, LOW, np.uint64)
    out: list[np.ndarray] = []
    shift, scale, word = np.uint64(63 - SCALE), np.uint64(SCALE), np.uint64(32)
    for s in range(steps - 1, -1, -1):
        m = n - s * LANES if s == steps - 1 else LANES
        x, f = state[:m], freq[s, :m]
        full = (x >> shift) >= f
        if full.any():
            out.append(x[full].astype(np.uint32))
            x = np.where(full, x >> word, x)
        quotient = x // f
        state[:m] = (quotient << scale) + (x - quotient * f) + start[s, :m]
    return state.tobytes() + (np.concatenate(out[::-1]).tobytes() if out else b"")


def decode_block(data: bytes, n: int, t: Tables) -> np.ndarray:
    state = np.frombuffer(data, np.uint64, LANES).copy()
    words, at = np.frombuffer(data, np.uint32, offset=8 * LANES), 0
    out = np.empty(n, np.uint32)
    mask, scale, word, low = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32), np.uint64(LOW)
    for i in range(0, n, LANES):
        m = min(LANES, n - i)
        x = state[:m]
        slot = x & mask
        ids = t.slots[slot]
        out[i : i + m] = ids
        x = t.freq[ids] * (x >> scale) + slot - t.start[ids]
        need = np.flatnonzero(x < low)
        if len(need):
            x[need] = (x[need] << word) | words[at : at + len(need)]
            at += len(need)
        state[:m] = x
    return out


def write_file(doc_ids: np.ndarray, lens: np.ndarray, ids: np.ndarray, t: Tables) -> bytes:
    payloads = [(min(BLOCK, len(ids) - i), encode_block(ids[i : i + BLOCK], t)) for i in range(0, len(ids), BLOCK)]
    head = HEAD.pack(MAGIC, VERSION, LANES, t.crc, len(doc_ids), len(ids), len(payloads))
    points = b"".join(struct.pack("<III", n, len(p), zlib.crc32(p)) for n, p in payloads)
    index = np.zeros(len(doc_ids), INDEX)
    index["doc"], index["n"] = doc_ids, lens
    return b"".join([head, points, index.tobytes(), *(p for _, p in payloads)])


def read_head(data: bytes) -> dict:
    magic, version, lanes, table, n_docs, n_tokens, n_blocks = HEAD.unpack_from(data)
    if (magic, version, lanes) != (MAGIC, VERSION, LANES):
        raise ValueError("not a file of this format and version")
    return {"table": table, "docs": n_docs, "tokens": n_tokens, "blocks": n_blocks}


def checkpoints(data: bytes, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(rows (first token, tokens, first byte, bytes, crc) of a file's blocks, its documents); checks the table."""
    head = read_head(data)
    if head["table"] != t.crc:
        raise ValueError("the file was written with another frequency table")
    points = np.frombuffer(data, "<u4", 3 * head["blocks"], HEAD.size).reshape(-1, 3).astype(np.int64)
    at = HEAD.size + 12 * head["blocks"]
    index = np.frombuffer(data, INDEX, head["docs"], at)
    n, size = points[:, 0], points[:, 1]
    return np.stack([np.cumsum(n) - n, n, at + index.nbytes + np.cumsum(size) - size, size, points[:, 2]], axis=1), index


def read_block(data: bytes, point: np.ndarray, t: Tables) -> np.ndarray:
    """The ids of one block, from its checkpoint alone."""
    _, n, at, size, crc = point.tolist()
    payload = data[at : at + size]
    if zlib.crc32(payload) != crc:
        raise ValueError("a block's checksum differs")
    return decode_block(payload, n, t)


def read_range(data: bytes, first: int, n: int, t: Tables) -> np.ndarray:
    """The file's ids from ``first`` on; only blocks that hold some are decoded."""
    points, _ = checkpoints(data, t)
    some = [p for p in points if p[0] < first + n and p[0] + p[1] > first]
    if not some:
        return np.zeros(0, np.uint32)
    ids = np.concatenate([read_block(data, p, t) for p in some])
    at = first - int(some[0][0])
    return ids[max(0, at) : at + n]


def read_file(data: bytes, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, tokens of each, all ids); checks the table and each block's crc."""
    points, index = checkpoints(data, t)
    parts = [read_block(data, p, t) for p in points]
    return index["doc"].astype(np.int64), index["n"].astype(np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class Pieces:
    """Texts as UTF-8 cut into pieces that are coded alone, by array operations over the bytes of many texts.

    No piece holds a blank. With ``known`` rules, runs of Latin letters, single digits and runs of marks are pieces, lower-cased
    as all the normalization they need. A part between blanks that holds any other character (apostrophes, "<", which
    special tokens begin with, letters beyond U+00FF, combining marks) stays whole and as it is.
    """

    BLANK, LETTER, MARK, DIGIT, OTHER = range(5)

    def __init__(self, known: bool):
        self.known, self.kinds = known, np.full(256, self.OTHER, np.uint8)
        self.kinds[list(b" \n")] = self.BLANK
        if known:
            self.kinds[list(b" \t\n\v\f\r")] = self.BLANK
            self.kinds[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = self.LETTER
            self.kinds[list(b"-.,;:!?#$%&*+/=@^_~`|>(){}[]\"\\")] = self.MARK
            self.kinds[list(b"0123456789")] = self.DIGIT

    def cut(self, data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(pieces in order, how many of them end with each text or before) of texts that end at ``ends`` in the bytes."""
        kind, low = self.kinds[data], np.frombuffer(bytearray(data), np.uint8)
        if self.known:
            low = np.frombuffer(bytearray(data).lower(), np.uint8)
            lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF, of which two are no letters
            lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
            kind[lead] = kind[lead + 1] = self.LETTER
            low[lead[data[lead + 1] < 0x9F] + 1] += 0x20
        there = kind != self.BLANK
        first = there.copy()  # where a part begins
        first[1:] &= ~there[:-1]
        new = kind == self.DIGIT
        new[1:] |= kind[1:] != kind[:-1]
        borders = np.append(0, ends[:-1])
        borders = borders[borders < len(data)]
        first[borders] = new[borders] = there[borders]
        new &= there
        if len(other := np.flatnonzero(kind == self.OTHER)):
            parts = np.flatnonzero(first)
            which = np.unique(np.searchsorted(parts, other, "right")) - 1
            turns = np.zeros(len(data), np.int8)
            turns[parts[which]] = 1
            turns[parts[which[which + 1 < len(parts)] + 1]] -= 1
            whole = np.cumsum(turns, dtype=np.int8).view(bool)
            new = new & ~whole | first
            np.copyto(low, data, where=whole)
        starts = np.append(np.flatnonzero(new[there]), np.count_nonzero(there))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(low[there])])
        return pieces, np.searchsorted(np.flatnonzero(new), ends)


class Tokenizer:
    """Texts to ids as little-endian 16-bit bytes by the tokenizers library, which gets each distinct piece of some texts once.

    The vocabulary's normalizer and pre-tokenizer never join what a blank or line feed parts, so parts can be encoded alone.
    Words of Latin letters need no more normalization than lower case and no more pre-tokenization than the byte
    alphabet, so the library's merge model gets them directly. What is coded stays in a bounded memo.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer as Library
        from tokenizers import models

        self.library = Library.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = None
        if known(spec):
            own = spec["model"]
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in own["merges"]]
            self.model = models.BPE(own["vocab"], merges, end_of_word_suffix=own["end_of_word_suffix"], cache_capacity=0)
        self.alphabet = byte_alphabet()
        self.pieces, self.cache = Pieces(self.model is not None), Cache(self.piece, MEMO)

    def piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if self.model is not None and LETTERS.fullmatch(text):
            shown = text if text.isascii() else piece.decode("latin-1").translate(self.alphabet)
            return array(self.kind.char, [t.id for t in self.model.tokenize(shown)]).tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def texts(self, column: pa.Array) -> Iterator[pa.Array]:
        """The ids of each text and the end id, as arrays that follow each other; each comes of ``SLICE`` bytes or one text."""
        column = column.cast(pa.large_binary()).fill_null(b"")
        if not len(column):
            return
        places = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(places, places[at] + SLICE, "right")) - 1)
            yield self.coded(data[places[at] : places[to]], places[at + 1 : to + 1] - places[at])
            at = to

    def coded(self, data: np.ndarray, ends: np.ndarray) -> pa.Array:
        pieces, before = self.pieces.cut(data, ends)
        found = pieces.dictionary_encode()
        ids = list(map(self.cache.__getitem__, found.dictionary.to_numpy(zero_copy_only=False).tolist()))
        order = np.insert(found.indices.to_numpy(), before, len(ids))
        joined = pa.array([*ids, self.end], pa.large_binary()).take(pa.array(order))
        places = np.frombuffer(joined.buffers()[1], np.int64)[np.append(0, before + np.arange(1, len(ends) + 1))]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(places), joined.buffers()[2]]).cast(pa.binary())


def known(spec: dict) -> bool:
    """Whether ``Pieces`` knows a vocabulary's rules."""
    normalizers = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        normalizers == ["NFC", "Replace", "Lowercase"]
        and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"] == {"Regex": WORDS}
        and spec["model"]["type"] == "BPE"
        and all(t["content"].startswith("<") for t in spec["added_tokens"])
    )


def byte_alphabet() -> dict[int, int]:
    """The rule of byte-level vocabularies: printable bytes stand for themselves, the others for letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(rest)}


def tokenizer(path: str, end_id: int) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(("rans", path, end_id), lambda: Tokenizer(path, end_id))


def token_files(docs: DataFrame, path: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """Tokenizes once and deals documents to files: rows (file_no, docs, lens, ids), arrays as bytes, doc_id ascending.

    Documents are dealt to ranges between quantiles of doc_id, one for each FILE_ROWS rows but RANGES at most, so that neither
    the borders nor the sketch they come from grow without bound; a range is cut into files as its sorted rows go by.
    """
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = max(1, min(RANGES, -(-src.count() // FILE_ROWS)))
    # quantiles come back as doubles; wherever they fall, a doc_id has one side of each border
    cuts = src.where(F.col("doc_id") > NO_ID).approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    shared = spark.sparkContext.broadcast(sorted({int(c) for c in cuts}))

    def tokens(batches):
        code, borders = tokenizer(path, end_id), shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            part, at = pa.array([bisect_right(borders, d) for d in ids], pa.int32()), 0
            for coded in code.texts(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(at, len(coded)), part.slice(at, len(coded)), coded], ["doc_id", "part", "ids"])
                at += len(coded)

    def files(batches):
        width = tokenizer(path, end_id).kind.itemsize
        docs_, raw, size, part, made = [], [], 0, None, 0

        def done() -> pa.RecordBatch:
            lens = np.array([len(r) // width for r in raw], "<u4")
            row = [pa.array([(part << 24) + made], pa.int64())]
            return pa.record_batch(row + [pa.array([x], pa.binary()) for x in (np.array(docs_, "<i8").tobytes(), lens.tobytes(), b"".join(raw))], ["file_no", "docs", "lens", "ids"])

        for batch in batches:
            for d, p, r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if docs_ and (p != part or size >= FILE_IDS or len(docs_) >= 2 * FILE_ROWS):
                    yield done()
                    docs_, raw, size, made = [], [], 0, made + 1 if p == part else 0
                part = p
                docs_.append(d)
                raw.append(r)
                size += len(r) // width
        if docs_:
            yield done()

    coded = src.mapInArrow(tokens, "doc_id long, part int, ids binary")
    dealt = coded.repartitionById(len(shared.value) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    return written(dealt.mapInArrow(files, "file_no long, docs binary, lens binary, ids binary"), "tokens")


def count_ids(files: DataFrame, size: int, kind: np.dtype) -> np.ndarray:
    """How often each id occurs in all files; at most one row for each id reaches the driver."""

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                counts += np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=size)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for i, n in files.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[i] = n
    return counts


def encode(docs: DataFrame, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Tables]:
    """Writes the files: rows (file_no long, tokens long, data binary) in the shared folder, and the shared table."""
    spark = bounded_batches(docs.sparkSession)
    files = token_files(docs, path, end_id, doc_id, text)
    code = tokenizer(path, end_id)
    kind = code.kind
    bounded_batches(spark, 1)  # a row is a whole file
    tables = Tables(count_ids(files, code.size, kind))
    shared = spark.sparkContext.broadcast(tables.freq)

    def run(batches):
        t = Tables.of(shared.value)
        for batch in batches:
            for number, d, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = write_file(np.frombuffer(d, "<i8"), np.frombuffer(n, "<u4"), np.frombuffer(raw, kind), t)
                yield pa.record_batch([pa.array([number], pa.int64()), pa.array([read_head(data)["tokens"]], pa.int64()), pa.array([data], pa.binary())], ["file_no", "tokens", "data"])

    out = written(files.mapInArrow(run, "file_no long, tokens long, data binary"), "rans", "none")
    bounded_batches(spark)
    drop_written(spark, files)
    return out, tables


def file_starts(files: DataFrame) -> DataFrame:
    """(file_no, before): the ids of all files before each. Sums run within a range of doc_ids, and over the ranges' totals,
    of which there are RANGES at most."""
    sizes = files.select("file_no", "tokens", F.shiftright("file_no", 24).alias("part"))
    to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = F.sum("tokens").over(to_here(Window.partitionBy("part").orderBy("file_no"))) - F.col("tokens")
    totals = sizes.groupBy("part").agg(F.sum("tokens").alias("total"))
    ranges = totals.select("part", (F.sum("total").over(to_here(Window.orderBy("part"))) - F.col("total")).alias("ranges_before"))
    return sizes.withColumn("within", within).join(F.broadcast(ranges), "part").select("file_no", (F.col("within") + F.col("ranges_before")).alias("before"))


def decode(files: DataFrame, tables: Tables) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    spark: SparkSession = files.sparkSession
    shared = spark.sparkContext.broadcast(tables.freq)

    def run(batches):
        t = Tables.of(shared.value)
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs, n, ids = read_file(data, t)
                ends = np.cumsum(n)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(np.full(len(n), number)), pa.array(docs, mask=docs == NO_ID), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())],
                    ["file_no", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    bounded_batches(spark, 1)  # a row is a whole file
    out = written(files.select("file_no", "data").mapInArrow(run, "file_no long, doc_id long, at long, n_tokens long, ids_crc32 long"), "rans-read")
    bounded_batches(spark)
    return out.join(few(file_starts(files)), "file_no").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
