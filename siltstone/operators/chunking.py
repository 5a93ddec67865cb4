"""Chunking: greedy packing on the largest boundary that fits, overlaps, table windows and merged blocks.

Packing is a fold over an array of parts inside one Catalyst expression, so a document needs no shuffle and no Python. What a
fold puts out grows in blocks (``functions/folds.py``), so its time grows with the text, not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.config import DEFAULTS
from siltstone.functions import folds
from siltstone.functions import text as T


def _flush(s: Column) -> Column:
    return F.when(s["held"] == "", s["out"]).otherwise(folds.put(s["out"], s["held"]))


def _take(s: Column, part: Column, limit: int) -> Column:
    """Appends a part that fits the window, or begins a new piece with it."""
    fits = F.length(s["held"]) + F.length(part) + 1 <= limit
    joined = F.when(s["held"] == "", part).otherwise(F.concat(s["held"], F.lit(" "), part))
    return F.when(fits, folds.state(joined, s["out"])).otherwise(folds.state(part, _flush(s)))


def _take_long(s: Column, sentence: Column, limit: int) -> Column:
    """A sentence beyond the window goes word by word, a word beyond it in cuts; what is left over begins the next piece."""

    def word(t: Column, w: Column) -> Column:
        cut = F.regexp_extract_all(w, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0))
        whole = folds.state(F.element_at(cut, -1), F.concat(_flush(t), F.slice(cut, F.lit(1), F.size(cut) - 1)))
        return F.when(F.length(w) > limit, whole).otherwise(_take(t, w, limit))

    return folds.fold(F.split(sentence, " "), F.lit(""), "string", word, lambda t: folds.state(t["held"], F.concat(_flush(s), t["out"])))


def split_long(text: Column, limit: int = DEFAULTS.chunk_chars) -> Column:
    """Pieces of at most ``limit`` characters: paragraphs, else sentences packed greedily, else words, else hard cuts."""

    def paragraph(p: Column) -> Column:
        def sentence(s: Column, x: Column) -> Column:
            return F.when(F.length(x) > limit, _take_long(s, x, limit)).otherwise(_take(s, x, limit))

        end = folds.fold(T.sentences(p), F.lit(""), "string", sentence, _flush)
        return F.when(F.length(p) <= limit, F.array(p)).otherwise(end)

    parts = F.flatten(F.transform(F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != ""), paragraph))
    pieces = F.when(F.length(text) <= limit, F.array(text)).otherwise(parts)
    return F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def with_overlap(pieces: Column, chars: int = DEFAULTS.overlap_chars) -> Column:
    """Each piece but the first begins with its predecessor's tail, from the next word on."""

    def one(p: Column, i: Column) -> Column:
        before = F.try_element_at(pieces, i.cast("int"))
        tail = F.when(F.length(before) > chars, F.substring(before, -chars, chars)).otherwise(before)
        space = F.instr(tail, " ")
        tail = F.when(space > 1, F.substring(tail, space + 1, F.length(tail))).otherwise(tail)
        return F.when((i == 0) | (F.trim(tail) == ""), p).otherwise(F.trim(F.concat(tail, F.lit(" "), p)))

    return F.transform(pieces, one)


def chunks(docs: DataFrame, keys: list[str], text: str = "text", limit: int = DEFAULTS.chunk_chars, overlap: int = DEFAULTS.overlap_chars) -> DataFrame:
    """(keys, ordinal from 1, chunk_text, token_count) of whole documents."""
    pieces = split_long(F.col(text), limit)
    if overlap:
        held = docs.select(*keys, pieces.alias("pieces"))
        pieces = with_overlap(F.col("pieces"), overlap)
    else:
        held = docs
    out = held.select(*keys, F.posexplode(pieces).alias("pos", "chunk_text"))
    return out.select(*keys, (F.col("pos") + 1).alias("ordinal"), "chunk_text", T.tokens_estimate(F.col("chunk_text")).alias("token_count"))


def table_windows(text: Column, heading: Column, limit: int = DEFAULTS.chunk_chars) -> Column:
    """A Markdown table by rows, heading and header repeated; a header without rows gives no window."""
    prefix = F.when(F.coalesce(heading, F.lit("")) == "", F.lit("")).otherwise(F.concat(heading, F.lit("\n\n")))
    room = F.greatest(F.lit(DEFAULTS.table_chars), F.lit(limit) - F.length(prefix))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    second = F.try_element_at(lines, F.lit(2))
    ruled = second.rlike(r"^\s*\|.*\|\s*$") | second.contains("---")
    head = F.when(ruled, F.concat(F.element_at(lines, 1), F.lit("\n"), second)).otherwise(F.element_at(lines, 1))
    body = F.slice(lines, F.when(ruled, 3).otherwise(2), F.size(lines))

    def row(s: Column, r: Column) -> Column:
        over = (s["held"] != "") & (F.length(head) + F.length(s["held"]) + 1 + F.length(r) > room)
        grown = F.when(s["held"] == "", r).otherwise(F.concat(s["held"], F.lit("\n"), r))
        return F.when(over, folds.state(r, _flush(s))).otherwise(folds.state(grown, s["out"]))

    windows = folds.fold(body, F.lit(""), "string", row, _flush)
    return F.when(F.size(lines) < 2, F.array(F.concat(prefix, text))).otherwise(F.transform(windows, lambda w: F.concat(prefix, head, F.lit("\n"), w)))


def table_heading(section: Column, page: Column) -> Column:
    has_section, has_page = F.coalesce(section, F.lit("")) != "", F.coalesce(page, F.lit(0)) != 0
    paged = F.concat(F.lit("(table, page "), page.cast("string"), F.lit(")"))
    return (
        F.when(has_section & has_page, F.concat(section, F.lit(" "), paged))
        .when(has_section, F.concat(section, F.lit(" (table)")))
        .when(has_page, paged)
        .otherwise(F.lit(""))
    )


def merged_blocks(blocks: DataFrame, limit: int = DEFAULTS.chunk_chars, least: int = DEFAULTS.merge_chars) -> DataFrame:
    """Chunks of parsed blocks (doc_id, seq, text, page_no, section, modality): runs of text blocks of one page and section
    are merged until they reach ``least`` characters; tables, captions, json and ocr stand alone.

    The merge is sequential within a document, so each document's blocks are one ordered array that one fold goes through.
    """
    order = F.array_sort(F.collect_list(F.struct("seq", "text", "page_no", "section", F.coalesce("modality", F.lit("text")).alias("modality"))))
    docs = blocks.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("doc_id").agg(order.alias("blocks"))
    kind = "struct<text:string,page_no:int,section:string,modality:string,size:int>"

    def step(s: Column, b: Column) -> Column:
        last = s["held"]
        plain = ~b["modality"].isin("table", "caption", "json", "ocr")
        joins = plain & (last["modality"] == "text") & last["page_no"].eqNullSafe(b["page_no"]) & last["section"].eqNullSafe(b["section"]) & (last["size"] < least)
        grown = F.struct(F.concat(last["text"], F.lit("\n\n"), b["text"]).alias("text"), last["page_no"].alias("page_no"), last["section"].alias("section"), F.lit("text").alias("modality"), (last["size"] + F.length(b["text"])).alias("size"))
        new = F.struct(b["text"].alias("text"), b["page_no"].alias("page_no"), b["section"].alias("section"), F.when(plain, "text").otherwise(b["modality"]).alias("modality"), F.length(b["text"]).alias("size"))
        return F.when(joins, folds.state(grown, s["out"])).otherwise(folds.state(new, ended(s)))

    def ended(s: Column) -> Column:
        return F.when(s["held"].isNull(), s["out"]).otherwise(folds.put(s["out"], s["held"]))

    merged = folds.fold(F.col("blocks"), F.lit(None).cast(kind), kind, step, ended)
    runs = docs.select("doc_id", F.posexplode(merged).alias("run", "b")).select("doc_id", "run", "b.*")
    text = F.col("text")
    pieces = (
        F.when(F.col("modality") == "text", with_overlap(split_long(text, limit)))
        .when(F.col("modality") == "table", table_windows(text, table_heading(F.col("section"), F.col("page_no")), limit))
        .otherwise(split_long(text, limit))
    )
    out = runs.select("doc_id", "run", "page_no", "section", "modality", F.posexplode(pieces).alias("at", "chunk_text"))
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("run", "at"))
    return out.select("doc_id", ordinal.alias("ordinal"), "chunk_text", "page_no", "section", "modality", T.tokens_estimate(F.col("chunk_text")).alias("token_count"))
