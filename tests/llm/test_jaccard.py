"""The Jaccard join against all pairs."""

import random
import re

import pytest

from siltstone.llm import jaccard


def brute(rows, p):
    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(words[i : i + p.size]) for i in range(max(1, len(words) - p.size + 1))) if words else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and p.den * len(a & b) >= p.num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def family(rng, base, edits, vocabulary):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return words


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, line = [], ["this", "very", "common", "line", "stands", "in", "many", "texts"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 60, 200, 500]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            words = family(rng, base, rng.randint(0, max(1, len(base) // 30)), vocabulary)
            rows.append(" ".join(words + (line if rng.random() < 0.3 else [])))
    rows += [rng.choice(rows) for _ in range(40)] + [None, "", " \n", "A b C", "a B c"]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "params"), [(1, jaccard.Params()), (2, jaccard.Params(size=5, num=80)), (3, jaccard.Params(group_rows=3, group_tokens=300))])
def test_components_are_brute_force(spark, seed, params):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.join(docs, params).collect())) == sorted(brute(rows, params))


@pytest.mark.parametrize("p", [jaccard.Params(), jaccard.Params(size=1, num=80), jaccard.Params(size=1, num=50)])
def test_linked_sets_share_a_key_and_pass_the_sketches(p):
    import numpy as np

    rng, linked = np.random.default_rng(7), 0
    order = (np.sort(rng.integers(0, 400, 40).astype(np.uint64)), rng.integers(3, 9, 40).astype(np.uint64))
    for _ in range(1500):
        a = np.unique(rng.integers(0, 400, int(rng.integers(1, 150))).astype(np.uint64))
        b = a[rng.random(len(a)) < 0.95]
        b = np.unique(np.concatenate([b, rng.integers(0, 400, int(rng.integers(0, 3))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and p.den * both >= p.num * (len(a) + len(b) - both):
            linked += 1
            x, y = jaccard.prefixes([a, b], order, p)
            assert set(x.tolist()) & set(y.tolist()), (len(a), len(b), both)
            i, j = jaccard.near_pairs(np.array([len(a), len(b)]), [jaccard.sketch(s, p.sketch_bits(len(s))) for s in (a, b)], p)
            assert {(i[0], j[0])} <= {(0, 1), (1, 0)}
    assert linked > 300


def test_near_pairs_of_unlike_sizes():
    import numpy as np

    rng, p = random.Random(6), jaccard.Params(num=80)
    n = np.array([rng.randint(20, 400) for _ in range(60)])
    base = [rng.getrandbits(200) for _ in range(3)]
    near = [rng.choice(base) ^ sum({1 << rng.randrange(200) for _ in range(rng.randint(0, 40))}) for _ in range(60)]
    blobs = [v.to_bytes(b, "little") for v, b in zip(near, [b for b in (32, 32, 64, 128) for _ in range(15)], strict=True)]

    def fold(v, bits, to):
        while bits > to:
            bits //= 2
            v = (v >> bits) ^ (v & ((1 << bits) - 1))
        return v

    want = set()
    for i in range(60):
        for j in range(i):
            to = 8 * min(len(blobs[i]), len(blobs[j]))
            apart = (fold(near[i], 8 * len(blobs[i]), to) ^ fold(near[j], 8 * len(blobs[j]), to)).bit_count()
            if p.den * min(n[i], n[j]) >= p.num * max(n[i], n[j]) and apart * (p.den + p.num) <= (n[i] + n[j]) * (p.den - p.num):
                want.add((j, i))
    got = [tuple(sorted(x)) for x in zip(*(x.tolist() for x in jaccard.near_pairs(n, blobs, p)), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_loners_go_and_linked_sets_stay(spark):
    p = jaccard.Params(window_tokens=500, part_tokens=300)
    rows = made(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    every = jaccard.written(jaccard.set_rows(jaccard.texts(docs, "doc_id", "text"), p), "sets")
    left = {r.node for r in jaccard.not_alone(every, p).collect()}
    given = every.where("sig is not null").select("doc_id", jaccard.node_of("sig").alias("node"), "sig").collect()
    comp = {d: c for d, _, c in brute(rows, p)}
    sigs = {}
    for r in given:
        sigs.setdefault(comp[r.doc_id], set()).add(r.sig)
    assert all(r.node in left for r in given if len(sigs[comp[r.doc_id]]) > 1)
    assert len(left) < len({r.sig for r in given})


def test_long_near_copies_link(spark):
    """A million words that differ in one place; each key carries no more than any other."""
    rng = random.Random(8)
    words = [f"{rng.getrandbits(40):x}" for _ in range(1_000_000)]
    other = [*words]
    other[500_000] = "different"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "something else entirely")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.join(docs).collect())) == [(1, 999_998, 1), (2, 999_998, 1), (3, 1, 3)]


def test_blocks_of_a_common_line(spark):
    """Many unlike texts with one long common line, families among them; keys are dealt by pairs of blocks."""
    rng, line = random.Random(4), [f"c{i}" for i in range(30)]
    rows = []
    for i in range(150):
        own = [f"x{i % 60}y{k}" for k in range(rng.choice([4, 6, 8]))]
        rows.append((i, " ".join(line + own if i % 2 else own + line)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for label_sets in (20, 1 << 16):
        p = jaccard.Params(size=2, num=80, group_rows=8, block_rows=16, group_queries=4, order_tokens=20, label_sets=label_sets)
        assert sorted(map(tuple, jaccard.join(docs, p).collect())) == sorted(brute(rows, p))


def test_edge_cases(spark, edge_docs, edge_rows, no_docs):
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(map(tuple, jaccard.join(edge_docs).collect()), key=key)
    assert got == sorted(brute([(r[0], r[1]) for r in edge_rows], jaccard.Params()), key=key)
    assert jaccard.join(no_docs).count() == 0
