"""Repeated strings against a table of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import passages, suffix


def brute(rows, length):
    count = Counter(d[i : i + length] for _, t in rows for d in [(t or "").encode()] for i in range(len(d) - length + 1))
    out = []
    for i, t in rows:
        d = (t or "").encode()
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(d)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def made(seed, length):
    rng = random.Random(seed)
    letters = "abcde éß\n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(rng.randint(length - 3, 3 * length)) for _ in range(6)]
    rows = []
    for _ in range(60):
        parts = [text(rng.randint(0, 4 * length)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        rows.append("".join(parts))
    base = text(8 * length)
    for _ in range(25):
        k = rng.randrange(len(base))
        rows.append(base[:k] + "#" + base[k + 1 :])
    rows += [rows[0], rows[0], None, "", "ab" * (2 * length), "x" * length, "x" * (length - 1), "y" * (length + 1)]
    rows += [f"{i:07d}" + shared[0] + f"{i:07d}" * 3 for i in range(80)]  # one passage with other surroundings in many texts
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "p"), [(1, suffix.Params(length=40, gram=12, more_grams=(36,))), (2, suffix.Params(length=40, gram=12, more_grams=(30, 36), group_bytes=300, batch_bytes=200)), (3, suffix.Params(length=25, gram=24, more_grams=(25,)))])
def test_removed_bytes_are_brute_force(spark, seed, p):
    rows = made(seed, p.length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, suffix.removed(docs, p).collect())) == sorted(brute(rows, p.length))


def test_suffix_order_is_sorted():
    rng = random.Random(5)
    for _ in range(300):
        parts = [bytes(rng.choice(b"abc" if rng.random() < 0.7 else b"a\xff\x00") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        ends = np.cumsum([len(x) for x in parts])
        text, limit = b"".join(parts), rng.choice([3, 10, 100])
        order = suffix.suffix_order(text, ends, limit)
        stop = [int(ends[np.searchsorted(ends, i, side="right")]) for i in range(len(text))]
        keys = [text[i : min(i + limit, stop[i])] for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys), (parts, limit)


def test_edge_cases(spark, edge_docs, edge_rows, no_docs):
    key = lambda r: tuple((x is not None, x) for x in r)
    p = suffix.Params(length=60, gram=16, more_grams=(52,))
    rows = [(r[0], r[1]) for r in edge_rows]
    assert sorted(map(tuple, suffix.removed(edge_docs, p).collect()), key=key) == sorted(brute(rows, 60), key=key)
    assert suffix.removed(no_docs).count() == 0
    rest = suffix.without_repeats(edge_docs.withColumnRenamed("word", "sig"), p)
    assert rest.columns == edge_docs.withColumnRenamed("word", "sig").columns and rest.count() == edge_docs.count()
    assert rest.where("sig is null").count() == 0


@pytest.mark.parametrize(("seed", "p"), [(1, passages.Params(words=7, gram=3)), (2, passages.Params(words=5, gram=5)), (3, passages.Params(words=4, gram=1))])
def test_shared_passages_are_brute_force(spark, seed, p):
    rng = random.Random(seed)
    part = lambda n: "".join(rng.choice(["a", "bé", "c-d", "E", "42", "üx"]) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    known = [part(rng.randint(2, 12)) for _ in range(8)]
    texts = ["".join(rng.choice([rng.choice(known), part(rng.randint(0, 9))]) for _ in range(rng.randint(0, 5))) for _ in range(60)]
    texts += [None, "", "x " * 40, texts[0], "y y y " * 20, "y y y " * 15, part(30) * 2, "only once in two rows of seven words", "only once in two rows of seven words"]
    windows = {}
    for t in {t or "" for t in texts}:
        d = t.encode()
        at = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", d)]
        windows[d] = [(at[i][0], at[i + p.words - 1][1]) for i in range(len(at) - p.words + 1)]
    count = Counter(x for d, spans in windows.items() for x in {d[a:b] for a, b in spans})
    rows = Counter((t or "").encode() for t in texts)
    want = {}
    for d, spans in windows.items():
        found = {i for a, b in spans if count[d[a:b]] > 1 for i in range(a, b)} | (set(range(len(d))) if rows[d] > 1 and spans else set())
        if found:
            want[d] = found
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    spans = passages.shared_spans(docs, p).join(suffix.sources(docs, "text").distinct(), "sig").collect()
    got = {bytes(r.data): {i for a, b in zip(r.firsts, r.lasts, strict=True) for i in range(a, b)} for r in spans}
    assert got == want and len(want) > 10
