"""Packing of long texts: equal to a plain loop across the folds' blocks, and in time that grows with the text."""

import random
import time

from pyspark.sql import functions as F

from siltstone.functions import folds
from siltstone.operators import chunking
from siltstone.sources import files


def packed(parts, limit):
    """The greedy rule as a loop: sentences, words of those beyond the window, cuts of words beyond it."""
    out, held = [], ""

    def take(part):
        nonlocal held
        if len(held) + len(part) + 1 <= limit:
            held = f"{held} {part}" if held else part
        else:
            out.extend([held] if held else [])
            held = part

    for part in parts:
        if len(part) <= limit:
            take(part)
            continue
        out.extend([held] if held else [])
        held = ""
        for word in part.split(" "):
            if len(word) <= limit:
                take(word)
                continue
            cuts = [word[i : i + limit] for i in range(0, len(word), limit)]
            out.extend(([held] if held else []) + cuts[:-1])
            held = cuts[-1]
    return [p.strip() for p in out + [held] if p.strip()]


def test_packing_equals_a_loop(spark):
    r = random.Random(5)
    rows = []
    for i in range(12):
        parts = [" ".join("é😀w"[: r.randint(1, 3)] * r.choice([1, 2, 3, 40]) for _ in range(r.randint(1, 25))) for _ in range(r.choice([1, 60, 64, 65, 700]))]
        parts = ["A" + p + "." for p in parts]
        rows.append((i, parts))
    docs = spark.createDataFrame([(i, " ".join(p)) for i, p in rows], "id int, text string")
    got = {r.id: r.pieces for r in docs.select("id", chunking.split_long(F.col("text"), 90).alias("pieces")).collect()}
    for i, parts in rows:
        whole = " ".join(parts)
        assert got[i] == ([whole] if len(whole) <= 90 else packed(parts, 90)), i


def test_folds_of_nothing_and_of_many(spark):
    one = spark.createDataFrame([(0, []), (1, None), (2, list(range(5000)))], "id int, xs array<int>")
    step = lambda s, x: folds.state(s["held"] + x, F.when(x % 2 == 0, folds.put(s["out"], x)).otherwise(s["out"]))
    got = one.select("id", folds.fold(F.col("xs"), F.lit(0), "int", step, lambda s: s).alias("s")).orderBy("id").collect()
    assert (got[0].s.held, got[0].s.out) == (0, []) and got[1].s is None
    assert got[2].s.held == sum(range(5000)) and got[2].s.out == list(range(0, 5000, 2))


def test_time_grows_with_the_text(spark):
    def run(n):
        text = " ".join(["Some sentence of no great length ends here."] * (n // 44))
        md = "\n".join(["## head", "body"] * (n // 13))
        spent = time.time()
        pieces = spark.createDataFrame([(text,)], "text string").select(F.size(chunking.split_long(F.col("text"), 200)).alias("n")).first().n
        heads = files.markdown_blocks(spark.createDataFrame([("a.md", md.encode())], "path string, content binary")).count()
        return pieces, heads, time.time() - spent

    run(1_000)
    few, many = run(500_000), run(4_000_000)
    assert many[0] > 7.9 * few[0] and many[1] > 7.9 * few[1]
    assert many[2] < 16 * few[2] + 5  # a quadratic fold takes 64 times as long
