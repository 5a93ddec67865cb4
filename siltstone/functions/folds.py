"""Folds that put out items. A fold's state is copied at every step, so that a list that grows in it costs the square of its
length. Here the parts are cut to blocks of blocks; a step sees what its own block has put out, and a block's end adds that to
the block above."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
LEVELS = 3  # beyond BLOCK ** LEVELS parts a list grows in the outermost fold, by as many parts at a time


def state(held: Column, out: Column) -> Column:
    return F.struct(held.alias("held"), out.alias("out"))


def put(out: Column, item: Column) -> Column:
    return F.concat(out, F.array(item))


def _blocks(parts: Column, size: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(parts) / size).cast("int"), F.lit(1)) - 1)
    return F.when(parts.isNotNull(), F.transform(starts, lambda i: F.slice(parts, i * size + 1, F.lit(size))))


def fold(parts: Column, held: Column, kind: str, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column], levels: int = LEVELS) -> Column:
    """``step(state, part)`` over an array's parts, from a state of ``held`` and no items of SQL type ``kind``; a state is
    (held, out), of which a step may add to ``out`` and not read it. ``finish`` makes the result of the last state. Null gives null,
    no parts give the first state."""
    none = F.array().cast(f"array<{kind}>")

    def block(s: Column, inner: Column) -> Column:
        return fold(inner, s["held"], kind, step, lambda r: state(r["held"], F.concat(s["out"], r["out"])), levels - 1)

    if levels == 0:
        return F.aggregate(parts, state(held, none), step, finish)
    return F.aggregate(_blocks(parts, BLOCK**levels), state(held, none), block, finish)
