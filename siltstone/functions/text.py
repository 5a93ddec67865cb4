"""Text functions as Column expressions. All but the encoder run in the JVM."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone import config as C

#: Patterns that results depend on.
SENTENCE = r"""(?<=[.!?])\s+(?=[A-Z0-9"'(\[])"""
CAPITALISED = r"\b[A-Z][A-Za-z0-9_-]{2,}\b"
ACRONYM = r"\b[A-Z]{2,6}\b"
MARKER = r"\[(\d{1,2})\]"
LIST_ITEM = r"^\s*(?:[-*•–]|\d+[.)])\s+"
LEAVES_FOLDER = r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:"
JUNK_ENTRY = r"(^|/)(__MACOSX|\.DS_Store|Thumbs\.db|\.git)(/|$)|(^|/)\._"
STANDALONE_CAPTION = r"(?i)^\s*(?:figure|fig\.?|table|chart|diagram|plate|exhibit)\s*[0-9]+"


def chain(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def clean(text: Column) -> Column:
    """Line ends, odd blanks, hyphenation and runs of white space or empty lines, in this order."""
    return chain(
        text, (r"\r\n?", "\n"), (" ", " "), ("﻿", ""), ("-\n", ""), (r"(?U)[^\S\n]+", " "), (" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"(?U)^\s+|\s+$", "")
    )


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, limit: int = 320) -> Column:
    flat = squeezed(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("...")))


def location(filename: Column, page: Column, section: Column) -> Column:
    by_section = F.when(F.coalesce(section, F.lit("")) != "", F.concat(filename, F.lit(" > "), section)).otherwise(filename)
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(filename, F.lit(" p."), page.cast("string"))).otherwise(by_section)


def tokens_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def normal_name(name: Column) -> Column:
    return chain(F.lower(F.trim(name)), (r"(?U)[^\w\s-]", ""), (r"(?U)\s+", " "), (r"^ | $", ""), ("^the ", ""), ("^a ", ""), ("^an ", ""))


def squashed(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE)


def all_found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def word_count(text: Column) -> Column:
    flat = squeezed(text)
    return F.when(F.coalesce(flat, F.lit("")) == "", 0).otherwise(F.size(F.split(flat, " ")))


def names_in(text: Column) -> Column:
    """Distinct capitalised words and acronyms that name something."""
    stop = F.array(*[F.lit(w) for w in C.CAPITALISED_STOPWORDS])
    return F.array_except(F.array_distinct(F.concat(all_found(text, CAPITALISED), all_found(text, ACRONYM))), stop)


def entity_density(text: Column) -> Column:
    """Names for each hundred words; 0 below 20 words."""
    n = word_count(text)
    return F.when(n < 20, F.lit(0.0)).otherwise(F.size(names_in(text)) / F.greatest(F.lit(1.0), n / 100.0))


def worth_extracting(text: Column, mode: str = "selective", least: float = 4.0) -> Column:
    if mode == "off":
        return F.lit(False)
    return word_count(text) >= 15 if mode == "on" else entity_density(text) >= least


def mime(filename: Column) -> Column:
    kinds = {
        ".pdf": "application/pdf", ".txt": "text/plain", ".md": "text/markdown", ".json": "application/json", ".png": "image/png",
        ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".webp": "image/webp", ".zip": "application/zip",
        ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    }
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ending(filename)), F.lit("application/octet-stream"))


def ending(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.[^./]+$", 0))


def allowed(filename: Column) -> Column:
    return ending(filename).isin(*C.EXTENSIONS)


def signature_fits(filename: Column, head: Column) -> Column:
    """The first bytes have a signature of the ending; endings without one accept all."""
    shown = F.hex(F.substring(head, 1, 16))
    out = F.lit(True)
    for end, signs in C.SIGNATURES.items():
        fits = F.lit(False)
        for sign in signs:
            fits = fits | shown.startswith(sign)
        out = F.when(ending(filename) == end, fits).otherwise(out)
    return out


def escapes(name: Column) -> Column:
    """A path that would leave its folder."""
    return F.regexp_replace(name, r"\\", "/").rlike(LEAVES_FOLDER)


def junk_entry(name: Column) -> Column:
    return name.rlike(JUNK_ENTRY) | name.endswith("/")


def lucene_escaped(term: Column) -> Column:
    return F.regexp_replace(term, r'([+\-!(){}\[\]^"~*?:\\/]|&&|\|\|)', r"\\$1")


def tri_state(raw: Column) -> Column:
    """true, false or null: neither yes nor no is null, not false."""
    word = F.lower(F.trim(raw))
    return F.when(word.isin("true", "yes", "1"), True).when(word.isin("false", "no", "0"), False)


def bounded_strings(values: Column, limit: int = 5, chars: int = 200) -> Column:
    short = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.substring(F.trim(v), 1, chars))
    return F.slice(F.filter(short, lambda v: F.coalesce(v, F.lit("")) != ""), 1, limit)


def json_object(raw: Column, schema: str) -> Column:
    """The outermost braces of a reply, fences and trailing commas removed, parsed; null where nothing parses."""
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.from_json(F.regexp_replace(inner, r",\s*([}\]])", "$1"), schema)


def without_reasoning(text: Column) -> Column:
    return F.trim(chain(text, (r"(?is)<think>.*?</think>", ""), (r"(?is)<think>.*$", "")))


def head_and_tail(text: Column, limit: int = 1200, mark: str = "\n...\n") -> Column:
    half = limit // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, half), F.lit(mark), F.substring(text, -half, half)))


def fallback_title(text: Column, default: str = "New chat") -> Column:
    short = F.rtrim(F.substring(squeezed(text), 1, 60))
    return F.when(F.coalesce(short, F.lit("")) == "", F.lit(default)).otherwise(short)


def usable_rewrite(text: Column) -> Column:
    bare = chain(F.trim(text), ("^[\"']+|[\"']+$", ""))
    return F.when(F.length(bare).between(5, 500) & ~bare.contains("\n"), bare).otherwise(F.lit(""))


def retry_class(message: Column) -> Column:
    low = F.lower(message)
    hit = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(low, m))
    return F.when(hit(C.FATAL_MARKERS), "fatal").when(hit(C.RETRYABLE_MARKERS), "retryable").otherwise("unknown")


def highlighted(text: Column, terms: list[str]) -> Column:
    import re

    wanted = sorted({t for t in terms if len(t) > 2}, key=lambda t: (-len(t), t))
    return F.regexp_replace(text, f"(?i)({'|'.join(map(re.escape, wanted))})", "<mark>$1</mark>") if wanted else text


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cell(value: Column) -> Column:
    return F.replace(squeezed(F.coalesce(value, F.lit(""))), F.lit("|"), F.lit("\\|"))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table: rows padded, empty ones dropped; null below two rows or columns."""
    cells = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(cells, F.size))
    padded = F.transform(cells, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    head = F.transform(F.element_at(padded, 1), lambda c, i: F.when(c == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(c))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0))), line)
    return F.when((F.size(padded) >= 2) & (width >= 2), F.array_join(F.concat(F.array(line(head), rule), body), "\n"))


def without_page_number(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?:(?:^|\n)[-– ]*\d{1,4}[-– ]*)+$", ""))


def reading_order(y: Column, x: Column) -> Column:
    """Sort key of blocks: rows of 12 points, rounded half to even, then x."""
    return F.struct(F.bround(y / 12, 0).alias("row"), x.alias("x"))


def overlap_share(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Of box a's area the share inside box b; boxes are (x0, y0, x1, y1)."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(area > 0, w * h / area).otherwise(F.lit(0.0))


def question_terms(question: Column, cap: int = 16) -> Column:
    """Words of three characters or more without stopwords and repeats: with digits first, proper nouns next, then long ones."""
    stop = F.array(*[F.lit(w) for w in C.QUESTION_STOPWORDS])
    words = F.filter(all_found(question, r"[A-Za-z0-9][A-Za-z0-9_-]{2,}"), lambda w: ~F.array_contains(stop, F.lower(w)))
    ranked = F.transform(
        words,
        lambda w, i: F.struct(
            F.when(w.rlike("[0-9]"), 0).when(w.rlike("^[A-Z]") & (w != F.upper(w)), 1).otherwise(2).alias("rank"), (-F.length(w)).alias("size"), i.alias("at"), w.alias("word")
        ),
    )
    lowered = F.transform(words, F.lower)
    first = F.filter(ranked, lambda r: F.array_position(lowered, F.lower(r["word"])) == r["at"] + 1)
    return F.slice(F.transform(F.array_sort(first), lambda r: r["word"]), 1, cap)


def fulltext_query(question: Column) -> Column:
    """The terms as an OR query, terms of more than four characters with one edit allowed."""
    terms = F.transform(question_terms(question), lucene_escaped)
    return F.array_join(F.transform(terms, lambda t: F.when(F.length(t) > 4, F.concat(t, F.lit("~1"))).otherwise(t)), " OR ")


def hashed_vector(dim: int = 64):
    """The default encoder: a function of a text column to a vector of unit length, counts of word hashes. Texts and questions
    are encoded alike; a text without words is all zeros."""

    @F.arrow_udf("array<float>")
    def encode(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts.to_pylist()):
            at = [zlib.crc32(w) % dim for w in re.findall(rb"[a-z0-9]+", (text or "").lower().encode())]
            np.add.at(out[i], at, 1)
        size = np.sqrt((out * out).sum(1, keepdims=True))
        out /= np.where(size > 0, size, 1)
        return pa.array(list(out), pa.list_(pa.float32()))

    return encode


def standalone_caption(text: Column) -> Column:
    """A caption that can stand as a block of its own: it names its figure or table and has six words or more."""
    return F.coalesce(text.rlike(STANDALONE_CAPTION) & (word_count(text) >= 6), F.lit(False))


def meaningful_image(width: Column, height: Column, spread: Column) -> Column:
    """No icon (under 64 pixels), no rule (sides apart by more than 20 times) and no plain area (grey deviation under 6)."""
    return F.coalesce((F.least(width, height) >= 64) & (F.greatest(width, height) <= 20 * F.least(width, height)) & (spread >= 6), F.lit(False))


def merged_rows(rows: Column) -> Column:
    """Of header rows (array of arrays) one: each column's parts that aren't blank, joined."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda r, i: F.trim(F.coalesce(F.try_element_at(r, i), F.lit("")))
    return F.transform(F.sequence(F.lit(1), width), lambda i: F.array_join(F.filter(F.transform(rows, lambda r: cell(r, i)), lambda c: c != ""), " "))


def header_rows(rows: Column) -> Column:
    """How many leading rows make a table's header: those before the first row, among the first five, whose first cell is a
    number; else sparse rows (a third of the cells empty, one at least) and the first dense one; else one."""
    head = F.slice(rows, 1, 5)
    numbered = F.filter(F.transform(head, lambda r, i: F.when(F.trim(F.coalesce(r[0], F.lit(""))).rlike(r"^\(?[0-9]+[.)]?$"), i)), lambda i: i.isNotNull())
    first = F.array_min(numbered)
    dense = lambda r: F.size(F.filter(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) == "")) < F.greatest(F.lit(1), F.floor(F.size(r) / 3))
    full = F.array_min(F.filter(F.transform(head, lambda r, i: F.when(dense(r), i)), lambda i: i.isNotNull()))
    return F.when(first > 0, first).when(full > 0, full + 1).otherwise(F.lit(1))


def split_header(rows: Column) -> Column:
    """struct(header, body) of a table's rows."""
    n = header_rows(rows)
    return F.struct(merged_rows(F.slice(rows, F.lit(1), n)).alias("header"), F.slice(rows, n + 1, F.greatest(F.size(rows) - n, F.lit(0))).alias("body"))


def image_size(content: Column) -> Column:
    """struct(format, width, height) from the first bytes of PNG, GIF and BMP files; null for others."""
    shown = F.hex(F.substring(content, 1, 30))
    number = lambda at, n: F.conv(F.substring(shown, 2 * at + 1, 2 * n), 16, 10).cast("long")
    little = lambda at, n: F.conv(F.concat(*[F.substring(shown, 2 * (at + i) + 1, 2) for i in reversed(range(n))]), 16, 10).cast("long")
    of = lambda name, w, h: F.struct(F.lit(name).alias("format"), w.alias("width"), h.alias("height"))
    return (
        F.when(shown.startswith("89504E470D0A1A0A") & (F.length(shown) >= 48), of("png", number(16, 4), number(20, 4)))
        .when(shown.startswith("47494638") & (F.length(shown) >= 20), of("gif", little(6, 2), little(8, 2)))
        .when(shown.startswith("424D") & (F.length(shown) >= 52), of("bmp", little(18, 4), little(22, 4)))
    )
