"""Count-only Viterbi over a unigram vocabulary (operator 1).

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic programming carries only
the best score and the piece count, no back pointers. Tie rules are the tokenizer's: candidates for one end are tried in
ascending start order and only a strictly better score replaces, so of equal paths the one whose last piece is longest
stays; a character without a piece of its own gets the unknown piece (lowest score minus 10), and adjacent unknowns are one.

A text is normalized as the vocabulary asks: one blank mark before the text, and each blank turned into the mark. The path
is found part by part: no piece goes on beyond a blank mark that follows another character, nor across a character of no
piece, so parts are independent and memoized.

Defined cases: null or empty text has 0 tokens and score 0; repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Cache, bounded_batches, kept, map_rows

#: Fixed values of the tokenizer: the blank mark and what an unknown costs below the lowest score.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
RUN = re.compile(f"{MARK}?\\w+|\n|[^\\w\n{MARK}]+|{MARK}")


def load_pieces(path: str) -> dict[str, float]:
    """The pieces of a sentencepiece model with the scores stored beside them, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


class Counter:
    """Score and piece count of texts, with memos for their parts."""

    def __init__(self, pieces: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.single = {p for p in pieces if len(p) == 1}
        # cut before a mark that follows another character only if no piece has one inside
        self.cut = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if self.cut else "(?s).+")
        self.cache = Cache(lambda part: complex(*self.word(part)[:2]))
        self.small = Cache(self.path)

    def path(self, text: str) -> tuple[float, int, bool, bool]:
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (size, score) in self.automaton.iter(text):
            ends[last + 1].append((size, score))
        best, count, tail, head = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            found = None
            for size, score in sorted(ends[end], reverse=True):  # ascending start
                total = best[end - size] + score
                if found is None or total > found[0]:
                    found = (total, end - size, False)
            if text[end - 1] not in self.single:
                total = best[end - 1] + self.unknown
                if found is None or total > found[0]:
                    found = (total, end - 1, True)
            best[end], start, unknown = found
            count[end] = count[start] + (not (unknown and tail[start]))
            tail[end], head[end] = unknown, head[start] if start else unknown
        return best[n], count[n], head[n], tail[n]

    def word(self, text: str) -> tuple[float, int, bool, bool]:
        """By runs of letters and of other characters, cut where no piece spans the border."""
        score, count, head, tail, held = 0.0, 0, None, False, ""
        for run in [*RUN.findall(text), ""]:
            if held and (not run or held[-1] + run[0] not in self.pairs):
                s, c, h, t = self.small[held]
                score, count, head, tail, held = score + s, count + c - (h and tail), h if head is None else head, t, run
            else:
                held += run
        return score, count, bool(head), tail

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        parts = self.words.findall(MARK + text.replace(" ", MARK))
        if self.cut and MARK in self.single:  # then no part begins with an unknown; both sums in one pass
            total = sum(map(self.cache.__getitem__, parts), 0j)
            return int(total.imag), total.real
        score, count, tail = 0.0, 0, False
        for s, c, h, t in map(self.word, parts):
            score += s
            count += c - (h and tail)
            tail = t
        return count, score


def token_counts(docs: DataFrame, pieces: dict[str, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, score (the best path's). ``pieces`` is a vocabulary, bounded by its file."""
    spark = bounded_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(pieces)

    def make():
        counter = kept(("unigram", hash(frozenset(shared.value.items()))), lambda: Counter(shared.value))

        def work(batch: pa.RecordBatch):
            out = [counter.count(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([c for c, _ in out], pa.int64()), pa.array([s for _, s in out], pa.float64())], ["doc_id", "n_tokens", "score"])

        return work

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_rows(src, make, "doc_id long, n_tokens long, score double")
