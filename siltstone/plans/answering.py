"""The bounded evidence loop over a table of questions: route, retrieve, rerank, judge, expand at most twice, answer.

The loop runs on the driver; each pass is one plan over all questions that still go on. Models are plug-ins with
deterministic defaults: lexical logits, term coverage, and an extractive answer of the best passages.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.config import DEFAULTS as D
from siltstone.functions import text as T
from siltstone.operators import answers as A
from siltstone.operators import evidence as E
from siltstone.operators import explore
from siltstone.operators import retrieval as R
from siltstone.plans import ingesting
from siltstone.plans.lineage import cut


#: Main calls and fast calls of a question, seconds of a table of questions.
BUDGET = (6, 12, float("inf"))


class Models:
    """What a deployment replaces: all take and return Columns, so an Arrow function fits as well as an expression."""

    def logit(self, question: Column, passage: Column) -> Column:
        return R.lexical_logit(question, passage)

    def sufficiency(self, question: Column, evidence: Column) -> Column:
        return A.coverage(question, evidence)

    def in_scope(self, question: Column, evidence: Column) -> Column:
        """Whether the corpus is about the question; null where the model can't tell."""
        return F.lit(None).cast("boolean")

    def probe(self, question: Column, missing: Column) -> Column:
        """A further query for what is missing."""
        return F.array_join(missing, " ")

    def hypothesis(self, question: Column) -> Column:
        """A made-up answer, used as a further query where it has more than 40 characters."""
        return F.lit(None).cast("string")

    def parts(self, question: Column) -> Column:
        return E.split_question(question)

    def rewritten(self, question: Column, history: Column) -> Column:
        """The question as it stands without its history; null where the model fails. The default adds the terms of the user's last
        line that the question doesn't have."""
        last = F.regexp_extract(history, r"(?s).*(?:^|\n)User: ([^\n]*)", 1)
        own = F.transform(T.question_terms(question), F.lower)
        more = F.filter(T.question_terms(last), lambda t: ~F.array_contains(own, F.lower(t)))
        return F.when(F.size(more) > 0, F.concat(F.trim(question), F.lit(" ("), F.array_join(F.slice(more, 1, 8), " "), F.lit(")")))


def condensed(questions: DataFrame, history: DataFrame | None, models: Models) -> DataFrame:
    """Questions that lean on earlier turns (query_id, history) in the model's words: 5 to 500 characters on one line, else as
    they are."""
    if history is None:
        return questions
    rows = questions.join(history, "query_id", "left")
    new = F.trim(models.rewritten(F.col("question"), F.col("history")))
    leans = A.needs_rewrite(F.col("question"), F.coalesce("history", F.lit("")) != "")
    fits = F.length(new).between(5, 500) & ~F.contains(new, F.lit("\n"))
    return rows.withColumn("question", F.when(leans & fits, new).otherwise(F.col("question"))).drop("history")


def prompts(passages: DataFrame, settled: DataFrame) -> DataFrame:
    """(query_id, prompt): what a model is asked for the answer. Passages (query_id, rank, text, and filename, page_no, section where
    known) stand numbered under the question; thin evidence and questions beside the corpus are named first; a question
    without passages says so. ``settled`` has query_id, question, sufficient, out_of_scope."""
    known = {"filename": F.lit("passage"), "page_no": F.lit(None).cast("int"), "section": F.lit(None).cast("string")}
    rows = passages.select("query_id", "rank", "text", *[(F.col(c) if c in passages.columns else v).alias(c) for c, v in known.items()])
    block = A.context_block(rows)
    scope, thin = "The corpus does not seem to hold what this question needs: say so, and use only what bears on it.\n\n", "The evidence is thin: say what is missing, and do not pad.\n\n"
    head = F.when(F.col("out_of_scope"), scope).when(~F.col("sufficient"), thin).otherwise("")
    asked = F.concat(F.lit("Question: "), F.col("question"))
    full = F.concat(head, asked, F.lit("\n\nPassages:\n\n"), F.col("context"), F.lit("\n\nAnswer from the passages and cite their numbers in brackets."))
    none = F.concat(asked, F.lit("\n\nNo passage was found for it."))
    return settled.join(block, "query_id", "left").select("query_id", F.when(F.col("context").isNull(), none).otherwise(full).alias("prompt"))


def described(profile: str | DataFrame) -> str:
    """A corpus in a line: as given, or the first names of documents (filename, seq) and how many more there are."""
    if isinstance(profile, str):
        return profile
    row = explore.profile_line(profile.withColumn("corpus", F.lit(1)), "corpus", "filename", "seq").first()
    return row.profile if row else ""


def scanned(chunks: DataFrame) -> E.Corpus:
    """A corpus without a stored index and graph: searches go over the texts."""

    def search(asked: DataFrame, k: int) -> DataFrame:
        found = R.bm25(chunks, asked, "chunk_id", "text", "query_id", "question").withColumnRenamed("doc_id", "chunk_id")
        return R.top_k(found.withColumn("score", F.round("score", 6)), "chunk_id", k)

    return E.Corpus(search, chunks)


def judge(pool: DataFrame, questions: DataFrame, chunks: DataFrame, models: Models) -> tuple[DataFrame, DataFrame]:
    """(reranked pool, verdicts with the window's chunks)."""
    full = pool.join(questions.select("query_id", "question"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    ranked = R.blended(full.withColumn("logit", models.logit(F.col("question"), F.col("text"))))
    rows = F.array_sort(F.collect_list(F.struct("rank", "text", "chunk_id")))
    window = ranked.where(F.col("rank") <= D.verify_window).groupBy("query_id").agg(rows.alias("w"))
    window = window.select("query_id", F.array_join(F.transform("w", lambda r: r["text"]), "\n").alias("evidence"), F.transform("w", lambda r: r["chunk_id"]).alias("window"))
    v = questions.select("query_id", "question").join(window, "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))
    scope = models.in_scope(F.col("question"), F.col("evidence"))
    v = v.withColumn("scope", scope).withColumn("v", A.verdict(models.sufficiency(F.col("question"), F.col("evidence")), F.col("scope"), F.coalesce(F.size("window"), F.lit(0))))
    asked = F.transform(T.question_terms(F.col("question")), F.lower)
    missing = F.filter(asked, lambda t: ~F.contains(F.lower(F.col("evidence")), t))
    return ranked, v.select("query_id", "question", "v.score", "v.sufficient", "v.out_of_scope", "scope", "window", missing.alias("missing"))


def answer(chunks: DataFrame, questions: DataFrame, models: Models | None = None, passes: int = D.max_passes, corpus: E.Corpus | None = None, history: DataFrame | None = None, profile: str | DataFrame = "", budget: tuple[int, int, float] = BUDGET) -> DataFrame:
    """(query_id, route, score, sufficient, passes, note, answer, calls, prompt): chunks (chunk_id, text), questions (query_id, question).

    Retrieves by route, reranks, judges; questions without enough evidence go on while each pass gains enough, at most
    ``passes`` times. What a further pass doesn't find ends with a note; where the last verdict is worse than an earlier one,
    that one's window comes back in front. ``profile`` describes the corpus (a line, or its documents); without it nothing counts as
    out of scope. ``budget`` bounds the main and the fast calls of a question and the seconds of the whole table: a rewrite, a
    verdict and a made-up answer are fast calls, the answer is a main one; a question whose budget is spent answers with what it
    has. ``prompt`` is what a model would be asked for the answer.
    """
    began = time.monotonic()
    models, corpus, profile = models or Models(), corpus or scanned(chunks), described(profile)
    spent = lambda fast: ingesting.budget_note(F.lit(0), fast, F.lit(time.monotonic() - began), *budget)  # the answer is the one main call
    standing = condensed(questions, history, models)
    routed = standing.withColumn("route", A.route(F.col("question"), graph_on=corpus.entities is not None))
    if history is None:
        routed = routed.withColumn("rewrites", F.lit(0))
    else:
        before = questions.select("query_id", F.col("question").alias("given"))
        routed = routed.join(before, "query_id").withColumn("rewrites", (F.col("given") != F.col("question")).cast("int"))
    routed = cut(routed.select("query_id", "question", "route", "rewrites"))
    asking = routed.where("route <> 'DIRECT'")
    pool = cut(E.retrieved(corpus, asking, parts=models.parts(F.col("question"))))
    ranked, verdicts = judge(pool, asking, chunks, models)
    rankings, judged = [cut(ranked.select("query_id", "chunk_id", "rank", "text", F.lit(1).alias("pass")))], cut(verdicts.withColumn("pass", F.lit(1)).withColumn("previous", F.lit(None).cast("double")).withColumn("dry", F.lit(False)))
    for n in range(2, passes + 1):
        stop = A.stop_reason(F.col("score"), F.col("previous"), F.col("scope"), F.lit(profile), F.col("out_of_scope"))
        going = judged.where((F.col("pass") == n - 1) & ~F.col("sufficient") & ~F.col("dry") & stop.isNull() & (F.size("missing") > 0))
        fast = going.join(routed.select("query_id", "rewrites"), "query_id").withColumn("fast", F.col("rewrites") + (n - 1))
        open_ = cut(fast.where(spent(F.col("fast")).isNull()).select(*judged.columns))
        if not open_.head(1):
            break
        made = models.hypothesis(F.col("question"))
        probes = open_.select("query_id", F.explode(F.array(models.probe(F.col("question"), F.col("missing")), F.when(F.length(made) > 40, made))).alias("question")).where("question is not null")
        probes = probes.select(F.struct("query_id", F.xxhash64("question").alias("probe")).alias("query_id"), "question")
        more = corpus.search(probes, 5).select("query_id.query_id", "chunk_id", "score", (F.col("rank") + 1000 * n).cast("long").alias("seq"), F.lit("expansion").alias("origin"))
        if corpus.entities is not None:
            near = E.widened(corpus.edges, corpus.mentions, cut(E.starts(open_.select("query_id", "question"), corpus.entities)))
            more = more.unionByName(near.select("query_id", "chunk_id", F.lit(D.graph_score).alias("score"), (F.col("seq") + 2000 * n).cast("long").alias("seq"), F.lit("graph").alias("origin")))
        new = cut(R.merged(more.join(pool.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"), "chunk_id", keys=("query_id",)))
        # a pass that finds nothing new ends the question with what it has
        found = new.select("query_id").distinct()
        dry = open_.join(found, "query_id", "left_anti").withColumn("pass", F.lit(n)).withColumn("previous", F.col("score")).withColumn("dry", F.lit(True)).withColumn("sufficient", F.lit(True))
        pool = cut(pool.unionByName(new.select(*pool.columns)))
        again = open_.join(found, "query_id", "left_semi")
        ranked, verdicts = judge(pool.join(again.select("query_id"), "query_id", "left_semi"), again, chunks, models)
        rankings.append(cut(ranked.select("query_id", "chunk_id", "rank", "text", F.lit(n).alias("pass"))))
        verdicts = verdicts.join(again.select("query_id", F.col("score").alias("previous")), "query_id").withColumn("pass", F.lit(n)).withColumn("dry", F.lit(False))
        judged = cut(judged.unionByName(verdicts.select(*judged.columns)).unionByName(dry.select(*judged.columns)))
    last, best = F.max_by(F.struct("score", "sufficient", "out_of_scope", "dry", "window", "pass"), "pass"), F.max_by(F.struct("score", "window"), F.struct("score", "pass"))
    settled = judged.groupBy("query_id").agg(last.alias("last"), best.alias("best"), F.max(F.when(~F.col("dry"), F.col("pass"))).alias("shown"))
    worse = F.col("last.score") < F.col("best.score")
    note = F.when(F.col("last.dry"), "nothing further was found").when(F.col("last.out_of_scope"), "outside the corpus").when(~F.col("last.sufficient"), "thin evidence").otherwise("")
    settled = cut(settled.select("query_id", F.greatest("last.score", "best.score").alias("score"), "last.sufficient", "last.out_of_scope", F.col("last.pass").alias("passes"), note.alias("note"), "shown", F.when(worse, F.col("best.window")).otherwise(F.array().cast("array<long>")).alias("front")))
    every = reduce(DataFrame.unionByName, rankings).join(settled.select("query_id", F.col("shown").alias("pass"), "front"), ["query_id", "pass"])
    final = A.restored(every.withColumnRenamed("rank", "seq"), "chunk_id", "seq", F.col("front"))
    cited = final.where(F.col("rank") <= 3).withColumn("piece", F.concat(T.snippet(F.col("text")), F.lit(" ["), F.col("rank").cast("string"), F.lit("]")))
    text = cited.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda r: r["piece"]), "\n").alias("answer"))
    shown = final.where(F.col("rank") <= D.answer_window).join(chunks.drop("text"), "chunk_id") if len(chunks.columns) > 2 else final
    asked = prompts(shown, routed.where("route <> 'DIRECT'").join(settled, "query_id"))
    out = routed.join(settled, "query_id", "left").join(text, "query_id", "left").join(asked, "query_id", "left")
    calls = F.when(F.col("passes") > 0, F.col("rewrites") + F.col("passes")).otherwise(F.col("rewrites"))
    out = out.withColumn("calls", calls).withColumn("note", F.coalesce(F.when((F.col("note") == "thin evidence"), spent(F.col("calls"))), F.col("note")))
    return out.select("query_id", "route", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("sufficient", F.lit(False)).alias("sufficient"), F.coalesce("passes", F.lit(0)).alias("passes"), F.coalesce("note", F.lit("")).alias("note"), F.coalesce("answer", F.lit("")).alias("answer"), "calls", F.coalesce("prompt", F.lit("")).alias("prompt"))


def trace(steps: DataFrame) -> DataFrame:
    """(query_id, total_ms, trace) of step rows (query_id, seq, name, duration_ms)."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "name", "duration_ms")))
    return steps.groupBy("query_id").agg(F.sum("duration_ms").alias("total_ms"), rows.alias("trace"))


def best_hits(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
