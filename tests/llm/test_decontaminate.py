"""Benchmark leaks against a brute-force scorer without index, blocks or bounds."""

import math
import random
import re
from collections import Counter

import numpy as np

from siltstone.llm import decontaminate as dec
from siltstone.llm.common import words_of


def made(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(6, 30)) + ". " + text(rng.randint(5, 12)) + ".") for i in range(60)]
    docs = []
    for d in range(120):
        body = text(rng.randint(1, 200))
        if d % 6 == 0:
            item = items[rng.randrange(60)][1]
            body = body + " " + item + " " + text(40)
        if d % 6 == 1:
            words = items[rng.randrange(60)][1].split()
            body = text(20) + " " + " ".join(words[: len(words) // 2]) + " " + text(50)
        docs.append((d, body))
    return items, docs


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(items, docs, p=dec.Params()):
    """BM25 of every item for every passage, and overlaps of word shingles, from the texts alone."""
    lists = [(i, words(t), t) for i, t in items if words(t)]
    n, mean, stride = len(lists), sum(len(w) for _, w, _ in lists) / len(lists), max(len(w) for _, w, _ in lists)
    df = Counter(x for _, w, _ in lists for x in set(w))
    weight = lambda x, w: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * (p.k1 + 1) / (w.count(x) + p.k1 * (1 - p.b + p.b * len(w) / mean))
    found = []
    for i, w, t in lists:
        own = {x: weight(x, w) for x in set(w)}
        size = min(p.shingle, len(w))
        grams = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
        head = len(words(t.rpartition(". ")[0] or t[: -1])) if ". " in t else (len(w) + 1) // 2
        border = max(1, head - size + 1)
        question, answer = set(grams[:border]), set(grams[max(0, min(len(grams) - 1, head - size + 1)) :])
        for d, text in docs:
            every = words(text)
            for a in range(0, len(every), stride):
                passage = every[a : a + 2 * stride]
                score = sum(own[x] for x in own if x in set(passage)) / sum(own.values())
                there = {tuple(passage[k : k + size]) for k in range(len(passage) - size + 1)}
                share = lambda part: len(part & there) / len(part)
                if score >= p.threshold - 1e-9 and share(set(grams)) >= p.overlap and min(share(question), share(answer)) >= p.part_overlap:
                    found.append((d, i, round(score, 9)))
    best = {}
    for d, i, s in found:
        best[d, i] = max(s, best.get((d, i), 0))
    return best


def test_leaks_are_brute_force(spark):
    items, docs = made()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(items, docs)
    assert {d for d, _ in want} >= set(range(0, 120, 6))
    # neither blocks nor shards change a pair or a score
    for p in (dec.Params(), dec.Params(block_items=1), dec.Params(block_items=16), dec.Params(block_items=1000), dec.Params(shard_items=7)):
        got = dec.leaks(table, spark.createDataFrame(items, "item_id long, text string"), p).collect()
        assert {(r.doc_id, r.item_id): round(r.score, 9) for r in got} == want, p


def test_retrieval_gives_all_items_above_the_threshold():
    items, docs = made(3)
    for p in (dec.Params(threshold=0.3), dec.Params(threshold=0.1, block_items=7), dec.Params(threshold=0.6)):
        index = dec.Index(items, p)
        for _, t in docs[:60]:
            terms = sorted({index.vocab[w] for w in words_of(t) if w in index.vocab})
            scores = {}
            for x in terms:
                for i, s in zip(index.items[x], index.impacts[x], strict=True):
                    scores[i] = scores.get(i, 0.0) + s
            want = {i: round(s, 9) for i, s in scores.items() if s >= p.threshold - 1e-9}
            assert {i: round(s, 9) for i, s in index.retrieve(np.array(terms))} == want if terms else True


def test_edge_cases(spark, edge_docs, edge_rows, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "mit license"), (3, "mit license")], "item_id long, text string")
    assert dec.leaks(no_docs, items).count() == 0
    assert dec.leaks(edge_docs, items.limit(0)).count() == 0
    # rows that hold the two words of an item that stands twice: it is found twice in each
    want = sorted(r[0] for r in edge_rows if " mit license " in f" {' '.join(words(r[1]))} ") * 2
    assert sorted(r.doc_id for r in dec.leaks(edge_docs, items).collect()) == sorted(want)
    rest = dec.clean(edge_docs, items.limit(2))
    assert rest.columns == edge_docs.columns and rest.count() == edge_docs.count()


def test_every_copied_item_is_found(spark):
    """Items with answers of a word, without sentences, of fewer words than a shingle, with a question mark."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 2, 4, 5, 6, 30)]
    texts += [f"{t}. {word()}." for t in texts] + [f"{t}? {word()} {word()}" for t in texts] + [f"{word()}.\n{t}" for t in texts] + ["?", f"{word()}?"]
    items = list(enumerate(texts))
    docs = [(i, " ".join(word() for _ in range(70)) + "\n" + t + "\n" + " ".join(word() for _ in range(70))) for i, t in items] + [(1000, " ".join(word() for _ in range(300)))]
    got = dec.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(i, i) for i, t in items if words_of(t)} <= {(r.doc_id, r.item_id) for r in got} and 1000 not in {r.doc_id for r in got}
