"""Token counts, byte-level BPE and token files against the libraries."""

import hashlib
import random
import zlib
from unittest.mock import MagicMock

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from siltstone.llm import bpe, rans, unigram  # noqa: E402


def key(row):
    return tuple((x is not None, x) for x in row)


def test_unigram_counts_are_the_librarys(spark, edge_docs, edge_rows, no_docs):
    from tokenizers import Tokenizer, models

    pieces = unigram.load_pieces(P.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], 0, False))
    want = sorted(((i, len(library.encode("▁" + t.replace(" ", "▁")).ids) if t else 0) for i, t, *_ in edge_rows), key=key)
    got = sorted(((r.doc_id, r.n_tokens) for r in unigram.token_counts(edge_docs, pieces).collect()), key=key)
    assert got == want
    assert unigram.token_counts(no_docs, pieces).count() == 0


def test_unigram_ties_keep_the_longest_last_piece():
    pieces = {"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -2.0}
    counter = unigram.Counter(pieces)
    assert counter.count("ab") == (2, -3.0)  # of three equal paths the one ending in the longest piece


def test_byte_bpe_is_the_librarys(spark, edge_docs, edge_rows, no_docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = []
    for i, t, *_ in edge_rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digest(edge_docs, path, P.PATTERN).collect()), key=key) == sorted(want, key=key)
    rows = bpe.encode(edge_docs, path, P.PATTERN).collect()
    texts = {i: t for i, t, *_ in edge_rows}
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() and r.n_tokens == len(r.ids) for r in rows)
    assert bpe.digest(no_docs, path, P.PATTERN).count() == 0


def test_encoded_rows_leave_a_worker_in_bounded_batches(monkeypatch):
    """However many rows and ids come in at once, and whatever the memos have dropped."""
    import pyarrow as pa
    import tiktoken

    path, works = P.path("byte_bpe_50k.tiktoken"), []
    monkeypatch.setattr(bpe, "map_rows", lambda src, make, schema: works.append(make))
    monkeypatch.setattr(bpe, "bounded_batches", lambda spark: None)
    monkeypatch.setattr(bpe, "F", MagicMock())
    monkeypatch.setattr(bpe, "MEMO", 50, raising=False)
    bpe.encode(MagicMock(), path, P.PATTERN)
    rng = random.Random(4)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(rng.randint(1, 200))) for _ in range(2000)]
    texts[:4] = [None, "", "one", "a long text " * 100_000]
    batch = pa.record_batch([pa.array([None, *range(1, 2000)], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = list(works[0]()(batch))
    assert all(b.schema.names == ["doc_id", "n_tokens", "ids", "decoded"] for b in got)
    assert all(len(b.column(2).flatten()) - b.column(1)[b.num_rows - 1].as_py() < 1 << 17 for b in got)
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == [None, *range(1, 2000)]
    for r, t in zip(rows, texts, strict=True):
        assert r["ids"] == library.encode_ordinary(t or "") and r["n_tokens"] == len(r["ids"]) and r["decoded"] == (t or "").encode()


def test_memos_go_with_the_task(monkeypatch):
    """Of a task's encoder nothing stays in the worker, which the next stage uses again."""
    import gc

    import pyarrow as pa

    path, works = P.path("byte_bpe_50k.tiktoken"), []
    monkeypatch.setattr(bpe, "map_rows", lambda src, make, schema: works.append(make))
    monkeypatch.setattr(bpe, "bounded_batches", lambda spark: None)
    monkeypatch.setattr(bpe, "F", MagicMock())
    bpe.encode(MagicMock(), path, P.PATTERN)
    gc.collect()
    before = {id(o) for o in gc.get_objects() if isinstance(o, bpe.Encoder)}
    gc.disable()
    try:
        work = works[0]()
        assert [b.num_rows for b in work(pa.record_batch([pa.array([1]), pa.array(["some words"])], ["doc_id", "text"]))] == [1]
        del work
        assert not [o for o in gc.get_objects() if isinstance(o, bpe.Encoder) and id(o) not in before]
    finally:
        gc.enable()


def test_native_fold_equals_the_worker_fold(spark):
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    words = [b" the", b"token", b"antidis", "général".encode(), b"zzzzz", b"\n\n", b"x"]
    table = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
    vocabulary = spark.createDataFrame([(bytearray(k), v) for k, v in ranks.items()], "piece binary, rank int")
    got = {bytes(r.word): (r.ids, bytes(r.decoded)) for r in bpe.encode_words_native(table, vocabulary).collect()}
    assert got == {w: (bpe.merge(w, ranks), w) for w in words}
    assert all(bpe.merge_long(w * 9, ranks) == bpe.merge(w * 9, ranks) for w in words)


def test_token_files_round_trip(spark, edge_docs, edge_rows, no_docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = sorted(((i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in edge_rows), key=lambda r: (r[0] is not None, r[0]))
    files, tables = rans.encode(edge_docs, path)
    got = rans.decode(files, tables).orderBy("start").collect()
    start = 0
    for (i, ids), r in zip(rows, got, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty, tables = rans.encode(no_docs, path)
    assert rans.decode(empty, tables).count() == 0


def test_files_follow_each_other_in_many_ranges(spark, monkeypatch):
    """Ranges that hold several files, and starts summed over files and ranges."""
    monkeypatch.setattr(rans, "FILE_ROWS", 7)
    monkeypatch.setattr(rans, "RANGES", 5)
    docs = spark.createDataFrame([(i * 3 % 400, "word " * (i % 11)) for i in range(300)], "doc_id long, text string").repartition(3)
    files, tables = rans.encode(docs, P.path("word_bpe_49k.json"))
    rows = sorted(rans.decode(files, tables).collect(), key=lambda r: r.start)
    assert files.count() > 15 and [r.doc_id for r in rows] == sorted(i * 3 % 400 for i in range(300))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False)) and rows[0].start == 0


@pytest.mark.parametrize("known", [True, False])
def test_texts_cut_by_bytes_have_the_librarys_ids(monkeypatch, known):
    """Any characters side by side, texts in slices of the bytes, slices of a column, rules that ``Pieces`` knows or not."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(6)
    library = Tokenizer.from_file(path)
    if not known:
        monkeypatch.setattr(rans, "known", lambda spec: False)
    code = rans.Tokenizer(path, 1)
    assert (code.model is not None) == known
    marks = [*map(chr, range(128)), *map(chr, range(0xA0, 0x180)), *" \n'<|>J\u030c\u0301\u0307\u00a0\u2003\u0085\u212a\u212bпривет中가\U0001f600ßŸ×÷σς١²"]
    marks += ["<|endoftext|>", "'re", "'LL", "don't", "aé", "\r\n", "E\u0301"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["".join(rng.choice("abAB12.,! \n") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts[10:13], texts[-2:] = ["", None, " "], [None, "\n"]
    want = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    for size in (1, 300, 8 << 20):
        monkeypatch.setattr(rans, "SLICE", size)
        got = [np.frombuffer(x.as_py(), code.kind).tolist() for part in code.texts(pa.array(texts, pa.string())[5:]) for x in part]
        assert got == want[5:]
    assert list(code.texts(pa.array([], pa.string()))) == []


def test_words_are_coded_once_whatever_stands_at_them():
    import pyarrow as pa

    code, asked = rans.Tokenizer(P.path("word_bpe_49k.json"), 1), []
    code.cache.compute = lambda piece: asked.append(piece) or code.piece(piece)
    words = ["thonering", "Thonering", "THONERING", "général", "GÉNÉRAL"]
    texts = [f"{a}{w}{b} {w}{a}7{w}" for w in words for a in ("", "(", "--", "!?") for b in (".", ",", "!!", ")")]
    assert sum(len(part) for part in code.texts(pa.array(texts * 3))) == 3 * len(texts)
    assert len(asked) == len(set(asked)) and set(asked) == {b"thonering", "général".encode(), b"7", b"(", b"--", b"!?", b".", b",", b"!!", b")"}


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 600_000])
def test_blocks_of_any_length(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 500).astype(np.uint16)
    tables = rans.Tables(np.bincount(ids, minlength=500))
    data = rans.write_file(np.array([7]), np.array([n]), ids, tables)
    assert (rans.read_file(data, tables)[2] == ids).all()
    for first, many in ((0, n), (n // 2, 10), (n - 5, 50), (n // 3, n // 3), (n + 7, 3)):
        assert (rans.read_range(data, max(0, first), many, tables) == ids[max(0, first) : max(0, first) + many]).all()
    if n:
        points, index = rans.checkpoints(data, tables)
        assert (rans.read_block(data, points[-1], tables) == ids[points[-1][0] :]).all() and index["n"].sum() == n
        broken = bytearray(data)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            rans.read_file(bytes(broken), tables)
