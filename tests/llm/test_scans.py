"""License scan, top-k search, quality and toxicity against brute force or held-out rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import dsir, kdtree, licenses, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def base_places(text):
    words = WORD.findall(lower(text or ""))
    places = sorted((i, k) for k, p in BASE.items() for i in range(len(words)) if words[i : i + len(p)] == p)
    return len(words), places


def test_license_base_places_are_brute_force(spark, edge_docs, edge_rows, no_docs):
    more = spark.createDataFrame(
        [(900, "Released under the MIT-License; mit license MIT LICENSE"), (901, "GNU General Public License & the Apache License"), (902, "permit license"), (903, "Apacje license, generel publik license")],
        "doc_id long, text string",
    )
    docs = edge_docs.select("doc_id", "text").unionByName(more)
    rows = [tuple(r) for r in docs.collect()]
    got = licenses.digest(licenses.scan(docs)).collect()
    want = []
    for i, t in rows:
        n, places = base_places(t)
        want.append((str(i), n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({k for _, k in places}))))
    assert sorted(((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(want, key=str)
    by = {r.doc_id: r for r in got}
    assert by[903].labels == "apache,gpl" and by[903].n_base == 0 and 0 < by[903].score < 1
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan(no_docs).count() == 0


def test_license_finds_every_text_within_the_errors():
    rng = random.Random(3)
    scanner = licenses.Scanner(licenses.NOTICES)
    for notice in licenses.NOTICES:
        for _ in range(30):
            s = list(notice.phrase)
            for _ in range(rng.randint(0, notice.errors)):
                i = rng.randrange(len(s))
                rng.choice([lambda: s.pop(i), lambda: s.insert(i, "q"), lambda: s.__setitem__(i, "q")])()
            flat = b"before " + "".join(s).strip().encode() + b" after"
            assert notice.label in {f.label for f in scanner.scan(flat)}, flat


def edits_to(phrase, text):
    """The fewest edits between the phrase and any run of whole words of the text."""
    words, best = text.split(), len(phrase)
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + len(phrase.split()) + 4) + 1):
            span = " ".join(words[i:j])
            row = list(range(len(span) + 1))
            for a, x in enumerate(phrase, 1):
                before, row = row, [a]
                for b, y in enumerate(span, 1):
                    row.append(min(before[b] + 1, row[-1] + 1, before[b - 1] + (x != y)))
            best = min(best, row[-1])
    return best


def test_license_labels_and_scores_are_brute_force(spark):
    rng, rows = random.Random(12), []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 3)):
            s = list(rng.choice(licenses.NOTICES).phrase)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                s[rng.randrange(len(s))] = rng.choice(["", "q", "e", "xy"])
            parts += ["".join(s), rng.choice(["", "public", "the license", "zebra"])]
        rows.append((i, " ".join(parts)))
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        found = [(n.label, 1 - e / len(n.phrase)) for n in licenses.NOTICES if (e := edits_to(n.phrase, " ".join(WORD.findall(lower(t))))) <= n.errors]
        assert got[i].labels == ",".join(sorted({k for k, _ in found})), t
        assert got[i].score == pytest.approx(max((s for _, s in found), default=0.0)), t
        assert got[i].n_base == sum(f.base for f in got[i].finds) and all(f.edits <= 3 for f in got[i].finds)


def brute_top(rows, k):
    ok = [(i, np.floor(64 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 20 == 0:
            best = sorted(((-int(a @ b), i) for i, b in ok if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("params", [kdtree.Params(), kdtree.Params(k=5, shard_rows=60, leaf_rows=4, block_rows=3, group_leaves=2)])
def test_top_k_is_brute_force(spark, params):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)] + [(400, None), (420, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (440, [float("nan")] * 6), (None, rows[0][1]), (460, [float("inf")] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = kdtree.top_k(kdtree.quantized(table, "vec_id", "embedding", 64), F.col("vec_id") % 20 == 0, params).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, params.k)
    assert kdtree.top_k(kdtree.quantized(table.limit(0), "vec_id", "embedding", 64), F.col("vec_id") % 20 == 0, params).count() == 0


def test_large_components_and_vectors_of_unlike_lengths(spark):
    """Scores beyond 2**53, and shorter vectors, which count as filled up with zeros."""
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(-(10**8), 10**8, rng.choice([40, 40, 7, 0]))]) for i in range(200)]
    rows += [(200 + i, [x + int(d) for x, d in zip(rows[0][1] or [1], rng.integers(0, 2, 40), strict=False)]) for i in range(40)]
    full = {i: v + [0] * (40 - len(v)) for i, v in rows}
    want = []
    for q in full:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(full[q], full[i], strict=True)), i) for i in full if i != q)[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    for p in (kdtree.Params(), kdtree.Params(shard_rows=50, leaf_rows=4, block_rows=3, group_leaves=2)):
        got = kdtree.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0, p).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_quality_is_brute_force(spark):
    """Weights by dictionaries of words and pairs, keys by the noise of (seed, id), the sample by a sorted list."""
    import math
    from collections import Counter

    import xxhash

    rng, p = random.Random(8), dsir.Params(buckets=50, fraction=0.4)
    rows = [(i % 70 if i % 9 else None, " ".join(rng.choice("a b c dé Ef g".split()) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(3, None), (500, ""), (501, "a b"), (501, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gumbel_key", F.lit("clash")).repartition(3)
    ids = {1, 2, 3, 5, 8, 501}

    def ngrams(text):
        words = [xxhash.xxh64_intdigest(w) for w in (text or "").lower().split()]
        m = 2**64
        pairs = [((a * 0x9E3779B97F4A7C15) % m) ^ b for a, b in zip(words, words[1:], strict=False)]
        pairs = [((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) % m for x in pairs]
        return [(x >> 17) % 50 for x in words + pairs]

    raw, good = Counter(b for _, t in rows for b in ngrams(t)), Counter(b for i, t in rows if i in ids for b in ngrams(t))
    share = lambda c, b: math.log((c[b] + 1) / (sum(c.values()) + 50))
    hashes = {r.i: r.h for r in spark.createDataFrame([(i,) for i in {i for i, _ in rows}], "i long").select("i", F.xxhash64(F.lit(17), "i").alias("h")).collect()}
    want = []
    for i, t in rows:
        weight = sum(share(good, b) - share(raw, b) for b in ngrams(t))
        want.append((i, len(ngrams(t)), weight, weight - math.log(-math.log((hashes[i] % 2**52 + 0.5) / 2**52))))
    target = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    order = lambda r: (r[0] is not None, r[0], r[1], r[2])
    got = sorted(map(tuple, dsir.importance(docs, target, p).collect()), key=order)
    assert [r[:2] for r in got] == [r[:2] for r in sorted(want, key=order)]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in sorted(want, key=order)])
    least = sorted((r[3] for r in want), reverse=True)[math.ceil(0.4 * len(want)) - 1]
    kept = sorted(map(tuple, dsir.resample(docs, target, p).collect()), key=order)
    assert [r[:2] for r in kept] == [r[:2] for r in sorted((r for r in want if r[3] >= least - 1e-9), key=order)]


def test_toxicity_fit_is_at_its_optimum():
    """The fitted model against slopes of the penalised loss taken by differences, and the severity against its formula."""
    import math

    rng = random.Random(5)
    rows = [(int(i % 3 == 0), sorted({rng.randrange(30) for _ in range(6)} | ({30 + rng.randrange(4)} if i % 3 == 0 else set()))) for i in range(240)]
    p = toxicity.Params(steps=6000, l1=1e-3)
    model = toxicity.fit(rows, p)
    odds = lambda f: math.log((sum(f in x for y, x in rows if y) + 0.5) / 81) - math.log((sum(f in x for y, x in rows if not y) + 0.5) / 161)
    strong = {f for f in range(34) if sum(f in x for _, x in rows) >= 5 and odds(f) >= 2}
    hits = [len(strong & set(x)) for _, x in rows]
    middle = np.quantile([h for h, (y, _) in zip(hits, rows, strict=True) if y], 0.5)
    grades = [0 if not y else 1 + int(h > middle) for h, (y, _) in zip(hits, rows, strict=True)]

    def loss(weights, cuts):
        total = 0.0
        for (_, x), g in zip(rows, grades, strict=True):
            logit = sum(weights.get(f, 0.0) for f in x)
            total += sum(math.log1p(math.exp(c - logit)) if g > k else math.log1p(math.exp(logit - c)) for k, c in enumerate(cuts))
        return total / len(rows) + p.l1 * sum(map(abs, weights.values()))

    assert 0 < len(model.weights) < 34 and list(model.cuts) == sorted(model.cuts)
    base, step = loss(model.weights, model.cuts), 1e-3
    for f in range(34):
        if sum(f in x for _, x in rows) >= 5:
            for d in (step, -step):
                assert loss(model.weights | {f: model.weights.get(f, 0.0) + d}, model.cuts) > base - 1e-6
    for k in range(2):
        for d in (step, -step):
            cuts = tuple(c + d * (i == k) for i, c in enumerate(model.cuts))
            assert loss(model.weights, cuts) > base - 1e-6
    for logit in (-3.0, 0.4, 7.0):
        assert sum(model.tails(logit)) == pytest.approx(sum(1 / (1 + math.exp(c - logit)) for c in model.cuts))


def test_toxicity_of_ties_repeats_and_odd_rows(spark, edge_docs, edge_rows):
    """The severity of each row by sets of words and beginnings."""
    model = toxicity.Model({toxicity.word_features(w, 20)[0]: v for w, v in ((b"alpha", 1.5), (b"beta", 2.0), (b"mit", -1.0))}, (1.0, 2.5), 20)
    got = toxicity.with_severity(edge_docs, model).select("doc_id", "text", "severity.*").collect()
    assert len(got) == len(edge_rows)
    for r in got:
        words = set(WORD.findall(lower(r.text or "")))
        logit = 1.5 * ("alpha" in words) + 2.0 * ("beta" in words) - ("mit" in words)
        tails = [1 / (1 + np.exp(c - logit)) for c in (1.0, 2.5)]
        assert r.expected_severity == pytest.approx(sum(tails)) and r.grade == sum(x >= 0.5 for x in tails) and r.toxic == (tails[0] >= 0.5)


def test_quality_keeps_target_like_texts(spark, edge_docs, no_docs):
    rng = random.Random(2)
    good, bad = ["the", "river", "was", "cold", "and", "deep"], ["buy", "now", "cheap", "pills", "click"]
    rows = [(i, " ".join(rng.choice(good if i % 5 else bad) for _ in range(40))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(1, 200) if i % 5], "doc_id long")
    kept = dsir.resample(docs, target).collect()
    assert len(kept) == 400 and sum(r.doc_id % 5 == 0 for r in kept) == 0
    keys = dsir.importance(docs, target)
    ordered = sorted((r.gumbel_key for r in keys.collect()), reverse=True)
    for k in (1, 3, 250, 500):
        assert dsir.kth_largest(keys, "gumbel_key", k, bins=8) == ordered[k - 1]
    assert dsir.resample(edge_docs, target.limit(0)).count() >= 40
    assert dsir.resample(no_docs, target).count() == 0


def test_toxicity_on_held_out_rows(spark, edge_docs, no_docs):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(30), rng.choice(["vile", "rotten", "wretched"]))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.with_severity(docs, model).select("doc_id", "severity.*").collect()}
    held = [(got[i].toxic, bool(y)) for i, _, y in rows if i >= 400]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert list(model.cuts) == sorted(model.cuts)
    out = toxicity.with_severity(edge_docs, model)
    assert out.count() == edge_docs.count() and out.where("severity.toxic").count() == 0
    assert toxicity.train(docs, labels.limit(0)).weights == {}
    assert toxicity.with_severity(no_docs, model).count() == 0


def test_license_lists_give_every_span(spark):
    docs = spark.createDataFrame(
        [
            (1, "mit licence mit licens mit license"),
            (2, "mit license, mit licens; mit license, mit licence"),
            (3, "generel public license x general publik licence general public license general pubic license"),
            (4, "bsd licence " * 3000),
            (5, None),
        ],
        "doc_id long, text string",
    )
    got = {r.doc_id: [(f.label, f.word, f.words, f.edits, f.base) for f in r.finds] for r in licenses.scan(docs).collect()}
    assert got[1] == [("mit", 0, 2, 1, False), ("mit", 2, 2, 1, False), ("mit", 4, 2, 0, True)]
    assert got[2] == [("mit", 0, 2, 0, True), ("mit", 2, 2, 1, False), ("mit", 4, 2, 0, True), ("mit", 6, 2, 1, False)]
    assert got[3] == [("gpl", 0, 3, 1, False), ("gpl", 4, 3, 2, False), ("gpl", 7, 3, 0, True), ("gpl", 10, 3, 1, False)]
    assert got[4] == [("bsd", 2 * i, 2, 1, False) for i in range(3000)]
    assert got[5] == []
