"""License scans by fuzzy short-notice search (operator 6).

Each notice is a short sequence of words. For up to k errors it is split into k + 1 pieces; by the pigeonhole principle a
match with at most k edits holds one piece unchanged, so exact finds of pieces locate all candidate windows. The regex
library's bounded-error matching then verifies a window, counts the edits and reports the span. Windows that hold no piece
are never looked at.

Words are runs of 0-9, a-z (A-Z lower-cased) and everything beyond ASCII. ``base`` notices count only where their words
stand consecutively without an edit; other finds give the labels alone. What is left of a window before and after a find is
searched on until nothing matches, so that notices which stand close together are all found. The score of a text is the best of 1 - edits /
length over its finds, 0 without any.

Defined cases: null or empty text has 0 words and no labels; overlapping places of one base notice all count; finds of one
notice with edits overlap neither each other nor its exact places; repeated rows are scanned each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import WORD_BYTES, bounded_batches, map_rows


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    errors: int
    base: bool = False


#: Notices: base phrases as the contract gives them, then longer ones with allowed edits.
NOTICES = (
    Notice("mit", "mit license", 1, True),
    Notice("apache", "apache license", 1, True),
    Notice("gpl", "general public license", 2, True),
    Notice("bsd", "bsd license", 1),
    Notice("mpl", "mozilla public license", 2),
    Notice("lgpl", "lesser general public license", 2),
    Notice("agpl", "affero general public license", 2),
    Notice("cc", "licensed under cc by", 2),
    Notice("cc", "creative commons attribution", 2),
    Notice("unlicense", "released into the public domain", 3),
    Notice("proprietary", "all rights reserved", 2),
)


def seeds(phrase: str, errors: int) -> list[tuple[str, int]]:
    """errors + 1 pieces of nearly equal length with their offsets."""
    n, k = len(phrase), errors + 1
    cuts = [round(i * n / k) for i in range(k + 1)]
    return [(phrase[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass(frozen=True)
class Find:
    label: str
    start: int
    end: int
    edits: int
    exact: bool
    score: float


class Scanner:
    def __init__(self, notices: tuple[Notice, ...]):
        import regex

        pattern = lambda n: rb"(?<![^ ])(?:" + regex.escape(n.phrase.encode(), literal_spaces=True) + rb"){e<=" + str(n.errors).encode() + rb"}(?![^ ])"
        self.notices = [(n, [(p.encode(), at) for p, at in seeds(n.phrase, n.errors)], regex.compile(pattern(n)), regex.compile(rb"(?b)" + pattern(n))) for n in notices]

    @staticmethod
    def flatten(text: str | None) -> tuple[list[bytes], bytes]:
        """The words, and the words with one blank between, which all spans refer to."""
        words = text.encode().translate(WORD_BYTES).split() if text else []
        return words, b" ".join(words)

    def windows(self, flat: bytes, pieces: list[tuple[bytes, int]], size: int, errors: int) -> list[tuple[int, int]]:
        """Merged windows around exact finds of the pieces, wide enough for any match that holds one."""
        found = set()
        for piece, at in pieces:
            i = flat.find(piece)
            while i >= 0:
                found.add((max(0, i - at - errors - 1), min(len(flat), i - at + size + errors + 1)))
                i = flat.find(piece, i + 1)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged

    @staticmethod
    def edited(flat: bytes, a: int, b: int, reach: int, first, best) -> list:
        """Matches with errors in [a, b), none of which overlaps a better one; a match has at most ``reach`` bytes.

        From the leftmost match the best one is sought near by, so that a window's search takes time in proportion to it.
        """
        out, parts = [], [(a, b)]
        while parts:
            a, b = parts.pop()
            m = first.search(flat, a, b) if a < b else None
            if not m:
                continue
            start, found = m.start(), None
            while m and (found is None or sum(m.fuzzy_counts) < sum(found.fuzzy_counts)):
                upto = flat.find(b" ", min(b, m.end() + reach), b)
                found, m = m, best.search(flat, start, b if upto < 0 else upto)
            out.append(found)
            parts += [(found.end() + 1, b), (start, found.start() - 1)]
        return out

    def scan(self, flat: bytes) -> list[Find]:
        out = []
        for notice, pieces, first, best in self.notices:
            phrase = notice.phrase.encode()
            for a, b in self.windows(flat, pieces, len(phrase), notice.errors):
                # exact places first: they count even where they overlap; the rest of the window is matched with errors
                rest, i = [], flat.find(phrase, a, b)
                while i >= 0:
                    end = i + len(phrase)
                    if (i == 0 or flat[i - 1] == 32) and (end == len(flat) or flat[end] == 32):
                        out.append(Find(notice.label, i, end, 0, True, 1.0))
                        rest.append((a, i - 1))
                        a = end + 1
                    i = flat.find(phrase, i + 1, b)
                for lo, hi in [*rest, (a, b)]:
                    if any(flat.find(p, max(lo, 0), hi) >= 0 for p, _ in pieces if lo < hi):
                        for m in self.edited(flat, lo, hi, len(phrase) + notice.errors, first, best):
                            edits = sum(m.fuzzy_counts)
                            out.append(Find(notice.label, m.start(), m.end(), edits, False, max(0.0, 1 - edits / len(phrase))))
        return out


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, finds (label, base, first and last word, edits, score) in order of their place."""
    base = {n.label for n in notices if n.base}
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64()), ("words", pa.int32()), ("edits", pa.int32()), ("score", pa.float64())]))

    def make():
        scanner = Scanner(notices)

        def work(batch: pa.RecordBatch):
            counts, rows = [], []
            for t in batch.column(1).to_pylist():
                words, flat = scanner.flatten(t)
                counts.append(len(words))
                finds = sorted(scanner.scan(flat), key=lambda f: (f.start, f.label, f.end))
                at = [flat.count(b" ", a, b) for a, b in pairwise([0, *(f.start for f in finds)])]  # words from one find to the next
                rows.append(
                    [
                        {"label": f.label, "base": f.exact and f.label in base, "word": word, "words": flat.count(b" ", f.start, f.end) + 1, "edits": f.edits, "score": f.score}
                        for f, word in zip(finds, accumulate(at), strict=True)
                    ]
                )
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(rows, kind)], ["doc_id", "n_words", "finds"])

        return work

    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_rows(src, make, "doc_id long, n_words long, finds array<struct<label:string,base:boolean,word:long,words:int,edits:int,score:double>>")


def digest(scanned: DataFrame) -> DataFrame:
    """The scan's rows as counts, first and last places of base notices, label lists, the best score, and all finds."""
    base = F.filter("finds", lambda f: f.base)
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda f: f.label))), ",")
    places = F.transform(base, lambda f: f.word)
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("finds")).alias("labels"),
        F.coalesce(F.array_max(F.transform("finds", lambda f: f.score)), F.lit(0.0)).alias("score"),
        "finds",
    )
