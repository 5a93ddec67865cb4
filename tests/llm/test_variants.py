"""Operators 11 to 13 against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import divergence, forest, spelling


def cosine(a, b):
    n = max(len(a), len(b))
    a, b = (np.array([*x, *[0.0] * (n - len(x))]) / max(map(abs, x)) for x in (a, b))
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def brute_neighbours(rows, k):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 50 == 0:
            found = sorted({(-round(cosine(v, w), 12), i) for i, w in good if i != q})
            out.setdefault(q, [(i, -s) for s, i in found][:k])
    return out


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(400)]
    rows += [(i, [1.0, 2.0, 3.0]) for i in range(400, 560)]  # one vector many times, shorter than others
    rows += [(i, [2.0, 4.0, 6.0, 0.0]) for i in range(560, 580)]
    rows += [(600, None), (650, [0.0] * 6), (700, [1.0, None]), (750, [1.0, float("nan")]), (800, [float("inf"), 1.0]), (850, []), (None, [1.0] * 6)]
    return rows + [(7, rows[7][1]), (900, [1e300, 1e300, 0.0, 0.0, 0.0, 1e-300])]


def as_lists(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def vector_frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.select(*[F.lit("clash").alias(c) for c in ("v", "rep", "ids", "unit", "leaf", "a.b")], "*").repartition(3)


def test_forest_with_all_leaves_is_exact(spark):
    rows = vector_rows()
    want = brute_neighbours(rows, 5)
    got = as_lists(forest.search(vector_frame(spark, rows), F.col("vec_id") % 50 == 0, forest.Params(recall=1.0, leaf_rows=32, unit_rows=64, block_queries=3)))
    assert got.keys() == want.keys()
    for q, found in want.items():
        assert [round(s, 9) for _, s in got[q]] == [round(s, 9) for _, s in found], q
        assert [i for i, _ in got[q]] == [i for i, _ in found] or len({round(s, 9) for _, s in found}) < 5, q
        assert q not in [i for i, _ in got[q]]


def test_forest_recall_at_production_parameters(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 24))
    x = (centres[rng.integers(0, 40, 6000)] + 0.7 * rng.standard_normal((6000, 24))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = as_lists(forest.search(rows, F.col("vec_id") % 50 == 0))
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & {i for i, _ in found})
        assert all(abs(s[i] - score) < 1e-12 for i, score in found)
    assert len(got) == 120 and hits >= 0.95 * 5 * len(got)


def test_fewer_leaves_for_data_with_structure():
    rng = np.random.default_rng(5)
    flat = forest.unit(rng.standard_normal((8000, 32)))
    line = forest.unit(rng.standard_normal((8000, 2)) @ rng.standard_normal((2, 32)))
    trees, of_flat = forest.fit(flat, len(flat), forest.Params())
    _, of_line = forest.fit(line, len(line), forest.Params())
    assert of_line < of_flat < trees.leaves


@pytest.mark.parametrize("n", [0, 1, 3])
def test_forest_of_few_rows(spark, n):
    rows = [(50 * i, [1.0, float(i)]) for i in range(n)]
    got = as_lists(forest.search(vector_frame(spark, rows), F.col("vec_id") % 50 == 0))
    assert {q: len(x) for q, x in got.items()} == ({50 * i: n - 1 for i in range(n)} if n > 1 else {})


def brute_variants(rows, p):
    n = Counter()
    for row, text in rows:
        for run in re.findall(f"[{p.letters}]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if row is None else row}:{word}".encode())
            if h % p.odd == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= p.min_letters and c >= p.min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, c in n.items():
        others = sorted((-n[x], x.encode(), x) for x in n if near(w, x))
        if others and -others[0][0] >= p.ratio * c:
            form[w] = others[0][2]
        out[w] = (c, len(others))
    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), c, k, n[form[w]] if w in form else None) for w, (c, k) in out.items()}


def spelling_rows():
    rng = random.Random(6)
    stems = ["abacus", "ünïcöde", "zebraiste", "contación", "contacion", "aaaaaaa", "mañanita", "abababab", "baobabab"]
    words = []
    for stem in stems:
        for times in (1, 12, 150):
            at = rng.randrange(len(stem) + 1)
            words += [stem[:at] + rng.choice("abé") + stem[at + rng.randrange(2) :]] * times
        words += [stem] * 400 + [stem[1:]] * 30 + [stem + "x"] * 3 + [stem.upper()] * 5 + [stem[::-1]] * 2
    words += ["kettenwort"] * 600 + ["kettenwor"] * 40 + ["kettewor"] * 3
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", ", ", "-", "×1"]).join(words[i::60])) for i in range(60)]
    return rows + [(None, "abacusé abacusé"), (60, None), (61, ""), (0, rows[0][1]), (62, "abacusab " * 50_000)]


def test_spelling_variants(spark, edge_rows):
    for p, rows in ((spelling.Params(task_words=7), spelling_rows()), (spelling.Params(min_letters=3, min_count=1, ratio=2, odd=5), [r[:2] for r in edge_rows]), (spelling.Params(), [])):
        docs = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id long, text string, word string, n string").withColumn("a.b", F.lit(1)).repartition(3)
        got = [tuple(r) for r in spelling.variants(docs, p).select("word", "form", "root", "n", "n_near", "form_n").collect()]
        assert len(got) == len(set(got)) and set(got) == brute_variants(rows, p)
    assert any(r[1] and r[1] != r[2] for r in brute_variants(spelling_rows(), spelling.Params()))  # chains are there


def test_near_words_share_a_key_at_every_place(spark):
    word = "abcdefghijklm"
    made = set()
    for size in (7, 8, 9, 13):
        base = word[:size]
        made |= {base} | {base[:i] + "z" + base[i:] for i in range(size + 1)} | {base[:i] + "z" + base[i + 1 :] for i in range(size)} | {base[:i] + base[i + 1 :] for i in range(size) if size > 7}
    counted = spark.createDataFrame([(w, 2) for w in made], "word string, n long")
    got = {(r.word, r.other) for r in spelling.near(counted).collect()}
    rows = brute_variants([(None, f"{w} {w}") for w in made], spelling.Params(odd=1 << 40))
    assert sum(r[4] for r in rows) == len(got) and all((b, a) in got for a, b in got)


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """Small tables as well as large ones whose size Spark takes for small, as after an explode, are joined by sorting."""
    plans, write = [], spelling.written

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(spelling, "written", watched)
    docs = spark.createDataFrame(spelling_rows(), "doc_id long, text string")
    plans.append(spelling.variants(docs)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


def brute_divergence(rows, p):
    rows = [tuple(x or "" for x in r) for r in rows]
    in_docs, counts, total = Counter(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = [t.translate({i: i + 32 for i in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        in_docs.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
        total[lang].update(terms)
    out = set()
    for lang in {r[0] for r in rows}:
        kept = [t for t in total[lang] if in_docs[lang, t] >= p.min_docs]
        v = len(kept)

        def weights(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        q, groups = weights(total[lang]), {s: weights(c) for (x, s), c in counts.items() if x == lang}
        for s, w in groups.items():
            pairs = [(sum((w[t] - o[t]) ** 2 // o[t] for t in kept), x) for x, o in groups.items() if x != s]
            terms = [((w[t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and w[t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, p.top_terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def test_source_divergence(spark):
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "über", "naïve", "delta", "ÉTÉ", "x", "don't", "日本", *[f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]]
    rows = [(rng.choice(["de", "en", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", None]), " ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(0, 40)))) for _ in range(300)]
    rows += [("fr", "s1", "seul"), ("fr", "s2", None), ("it", "s9", "solo solo solo"), ("en", "no words", "42 !!"), ("en", "", ""), ("en", None, None), ("de", "s0", "alpha " * 100_000), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "c", "c", 1) for r in rows], "lang string, source string, text string, term string, n string, p0 long").withColumn("a.b", F.lit(1)).repartition(4)
    for p in (divergence.Params(), divergence.Params(min_docs=1, top_terms=3, salts=2, task_terms=10)):
        got = [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in divergence.audit(df, p).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, p)
    assert divergence.audit(df.limit(0)).count() == 0
