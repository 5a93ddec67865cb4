"""Routing, verdicts, citations and grounding of answers: batch expressions over tables of questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import config as C
from siltstone.functions import text as T

D = C.DEFAULTS


def hits(text: Column, marks: tuple[str, ...]) -> Column:
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return sum((F.contains(padded, F.lit(m)).cast("int") for m in marks), F.lit(0))


def proper_nouns(text: Column) -> Column:
    """Capitalised words of more than two characters after the first word."""
    words = F.split(T.squeezed(text), " ")
    return F.size(F.filter(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: w.rlike("^[A-Z]") & (F.length(w) > 2)))


def heuristic_route(question: Column, graph_on: bool = True) -> Column:
    """DIRECT, MULTIHOP, GRAPH, VECTOR, or null where the question is ambiguous."""
    text = F.trim(question)
    multi, relation, nouns = hits(text, C.MULTIHOP_MARKERS), hits(text, C.RELATION_MARKERS), proper_nouns(text)
    lookup = F.lit(False)
    for start in C.LOOKUP_STARTS:
        lookup = lookup | F.lower(text).startswith(start)
    return (
        F.when((F.coalesce(text, F.lit("")) == "") | text.rlike(C.GREETING) | (text.rlike(C.META) & (T.word_count(text) <= 12)), "DIRECT")
        .when((multi >= 1) & ((nouns >= 2) | (multi >= 2)), "MULTIHOP")
        .when(F.lit(graph_on) & (relation >= 1) & (nouns >= 2), "GRAPH")
        .when(lookup & (relation == 0) & (multi == 0) & (nouns <= 1), "VECTOR")
    )


def parsed_route(value: Column) -> Column:
    word = F.upper(F.trim(value))
    return F.when(word.isin("VECTOR", "GRAPH", "HYBRID", "MULTIHOP", "DIRECT"), word)


def route(question: Column, forced: Column | None = None, model: Column | None = None, graph_on: bool = True) -> Column:
    """Forced, else heuristic, else the model's word; unparseable is HYBRID, and a graph route without a graph is VECTOR."""
    choice = F.coalesce(parsed_route(forced) if forced is not None else F.lit(None), heuristic_route(question, graph_on), parsed_route(model) if model is not None else F.lit(None), F.lit("HYBRID"))
    return choice if graph_on else F.when(choice == "GRAPH", "VECTOR").otherwise(choice)


def needs_rewrite(question: Column, has_history: Column) -> Column:
    text = F.trim(question)
    words = rf"(?i)\b(?:{'|'.join(C.REFERENCE_WORDS)})\b"
    phrase = F.lit(False)
    for p in C.REFERENCE_PHRASES:
        phrase = phrase | F.contains(F.lower(text), F.lit(p))
    return has_history & ((F.length(text) < 12) | text.rlike(words) | phrase)


def coverage(question: Column, evidence: Column) -> Column:
    """The default sufficiency score: the share of the question's terms that the evidence holds, 3 places."""
    asked = F.transform(T.question_terms(question), F.lower)
    low = F.lower(evidence)
    got = F.size(F.filter(asked, lambda t: F.contains(low, t)))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.round(got / F.size(asked), 3))


def verdict(score: Column, in_scope: Column, n_chunks: Column) -> Column:
    """struct(score, sufficient, out_of_scope): scores are clamped, a missing one counts half."""
    clamped = F.when(n_chunks == 0, F.lit(0.0)).otherwise(F.coalesce(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), F.lit(0.5)))
    enough = (n_chunks > 0) & (clamped >= D.sufficient)
    return F.struct(clamped.alias("score"), enough.alias("sufficient"), (~enough & F.coalesce(~in_scope, F.lit(False))).alias("out_of_scope"))


def with_previous(verdicts: DataFrame, key: str, at: str) -> DataFrame:
    """Adds the previous pass's score, and the best window so far (of equal scores the later)."""
    order = Window.partitionBy(key).orderBy(at)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return verdicts.withColumn("previous", F.lag("score").over(order)).withColumn("best_pass", F.max_by(at, F.struct("score", at)).over(so_far)).withColumn("best_score", F.max("score").over(so_far))


def stop_reason(score: Column, previous: Column, in_scope: Column, shape: Column, out_of_scope: Column) -> Column:
    """'out_of_scope', 'stalled' or null to go on."""
    low = (score < D.out_of_scope) & F.coalesce(~F.coalesce(in_scope, F.lit(False)), F.lit(True)) & (F.coalesce(shape, F.lit("")) != "")
    return F.when(out_of_scope, "out_of_scope").when(previous.isNull() | (score - previous >= D.least_gain), F.lit(None)).when(low, "out_of_scope").otherwise("stalled")


def turnover(window: Column, before: Column) -> Column:
    return F.size(F.array_except(window, before)) / F.greatest(F.size(window), F.lit(1))


def restored(pool: DataFrame, item: str, seq: str, best: Column) -> DataFrame:
    """The pool with the best window's items first, in its order."""
    place = F.array_position(best, F.col(item))
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(place > 0, 0).otherwise(1), F.when(place > 0, place).otherwise(F.col(seq)), seq)))


def markers(answer: Column, n: Column) -> Column:
    """Distinct valid marker numbers in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(T.all_found(answer, T.MARKER, 1), lambda x: x.cast("int")), lambda i: (i >= 1) & (i <= n)))


def renumbered(answer: Column, n: Column) -> Column:
    """The answer with valid markers renumbered densely by first appearance and invalid ones dropped."""
    used = markers(answer, n)
    parts = F.split(F.regexp_replace(answer, T.MARKER, "\u0001[$1]\u0001"), "\u0001")

    def one(p: Column) -> Column:
        index = F.regexp_extract(p, r"^\[(\d{1,2})\]$", 1)
        at = F.array_position(used, F.when(index != "", index.cast("int")))
        return F.when(index == "", p).when(at > 0, F.concat(F.lit("["), at.cast("string"), F.lit("]"))).otherwise(F.lit(""))

    joined = F.array_join(F.transform(parts, one), "")
    return F.regexp_replace(T.chain(joined, (r" +([.,;:])", "$1"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")), r"^\s+|\s+$", "")


def about_evidence(sentence: Column) -> Column:
    return sentence.rlike(C.EVIDENCE_REFERENCE) & sentence.rlike(C.ABSENCE)


UNIT = "array<struct<list:boolean,open:boolean,text:string>>"


def claim_units(answer: Column) -> Column:
    """Array of (list, text): lines, but a list with its lead-in is one unit; headings end a list, blank lines don't."""
    lines = F.filter(F.transform(F.split(answer, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")

    def step(acc: Column, line: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        is_item = line.rlike(T.LIST_ITEM)
        grows = is_item & F.coalesce(last["open"], F.lit(False))
        closed = F.when(F.size(acc) == 0, acc).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["list"].alias("list"), F.lit(False).alias("open"), last["text"].alias("text")))))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.lit(True).alias("list"), F.lit(True).alias("open"), F.concat(last["text"], F.lit(" "), line).alias("text"))))
        opens = is_item | line.endswith(":")
        new = F.concat(closed, F.array(F.struct(opens.alias("list"), opens.alias("open"), line.alias("text"))))
        return F.when(line.startswith("#"), closed).when(grows, grown).otherwise(new).cast(UNIT)

    return F.aggregate(lines, F.array().cast(UNIT), step)


def answer_sentences(line: Column) -> Column:
    """Sentences of a line; trailing markers belong to their sentence and ellipses end none."""
    marked = F.regexp_replace(line, r"""(?<![.!?])([.!?](?![.!?])(?:\s*\[\d{1,2}\])*)(?=\s+["'(A-Z]|\s*$)""", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def grounding(answer: Column, n_citations: Column, least: int = D.claim_chars) -> Column:
    """The share of claims that cite a source, 3 places; null for blank answers or no claims, 0 without citations."""
    pieces = F.flatten(F.transform(claim_units(answer), lambda u: F.when(u["list"], F.array(u["text"])).otherwise(answer_sentences(u["text"]))))
    claims = F.filter(pieces, lambda p: (F.length(p) >= least) & ~about_evidence(p))
    cited = F.size(F.filter(claims, lambda p: p.rlike(T.MARKER)))
    share = F.when(F.size(claims) > 0, F.round(cited / F.size(claims), 3))
    return F.when(F.coalesce(F.trim(answer), F.lit("")) == "", F.lit(None).cast("double")).when(n_citations == 0, F.lit(0.0)).otherwise(share)


def context_block(passages: DataFrame, query: str = "query_id", limit: int = D.answer_window) -> DataFrame:
    """(query, context): numbered passages (rank, filename, page_no, section, text) under their places."""
    place = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("filename"), F.coalesce(F.concat(F.lit(", page "), F.col("page_no").cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(", section: "), "section"), F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("rank", F.concat(place, F.lit("\n"), F.col("text")).alias("t"))))
    return passages.where(F.col("rank") <= limit).groupBy(query).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n---\n\n").alias("context"))


def chosen_images(cited: Column, rest: Column, cap: int = 4) -> Column:
    return F.slice(F.array_distinct(F.concat(cited, rest)), 1, cap)


def phase_of(grounded: Column) -> Column:
    return F.when(grounded >= 0.8, "well grounded").when(grounded >= 0.5, "partly grounded").when(grounded.isNotNull(), "weakly grounded").otherwise("not measured")
