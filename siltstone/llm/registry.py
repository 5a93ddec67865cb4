"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, decontaminate, divergence, dsir, forest, jaccard, kdtree, licenses, rans, spelling, suffix, toxicity, unigram
from siltstone.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"), unigram.load_pieces(vocabulary("piece_bpe_32k.model")))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1")
    return dsir.resample(table(spark, sf_dir, "documents"), target)


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_severity(docs, model).select("doc_id", "severity.*")


def op5_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, tables = rans.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return rans.decode(files, tables)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = kdtree.quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return kdtree.top_k(vectors, F.col("vec_id") % 20 == 0)


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_importance_resampling,
        op3_benchmark_leaks,
        op4_toxicity_severity,
        op5_rans_tokens,
        op6_license_scan,
        op7_exact_top_k,
        op8_repeated_strings,
        op9_jaccard_join,
        op10_byte_bpe,
        op11_nearest_neighbours,
        op12_spelling_variants,
        op13_source_divergence,
    )
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL: dict[str, str] = {}

#: Scores of quantized vectors for each query against every other row, ranked.
ORACLE_SQL["op7_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""

#: Words by whole-text runs and a bitwise crc32; near words by shared deletions of one letter, a way of its own.
ORACLE_SQL["op12_spelling_variants"] = r"""
WITH crc AS (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(0, 256) r(b)
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents WHERE text IS NOT NULL
), lower_ AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT w, n, xor(list_reduce(list_transform(range(0, length(hex(encode(doc_id || ':' || w))) // 2), lambda i: ('0x' || substr(hex(encode(doc_id || ':' || w)), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM lower_, crc
), changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
  SELECT word, n, word AS v FROM words
  UNION SELECT word, n, left(word, i::INT) || substr(word, i::INT + 2) FROM words, unnest(range(0, length(word))) u(i)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.v = b.v AND a.word <> b.word
  WHERE abs(length(a.word) - length(b.word)) <= 1 AND CASE WHEN length(a.word) = length(b.word) THEN
    len(list_filter(range(1, length(a.word) + 1), lambda i: a.word[i] <> b.word[i])) = 1 ELSE length(a.v) = least(length(a.word), length(b.word)) END
), best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, min({'a': -other_n, 'b': encode(other)}) AS x FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -x.a >= 10 * w.n THEN decode(x.b) END AS form, CASE WHEN -x.a >= 10 * w.n THEN -x.a END AS form_n
  FROM words w LEFT JOIN best USING (word)
), follow AS (
  SELECT word, form AS upper_form FROM formed WHERE form IS NOT NULL
), chain AS (
  WITH RECURSIVE c AS (
    SELECT word, upper_form, 1 AS hops FROM follow
    UNION ALL SELECT c.word, f.upper_form, hops + 1 FROM c JOIN follow f ON f.word = c.upper_form
  ) SELECT word, arg_max(upper_form, hops) AS root FROM c GROUP BY word
)
SELECT word, form, coalesce(root, word) AS root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM formed LEFT JOIN chain USING (word)
"""

#: Every group against every kept term.
ORACLE_SQL["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang
), groups_ AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS c FROM t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL
), sizes AS (
  SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (coalesce(s.n, 0) + l.v) AS p, 1 + (1000000000 * (k.c + 1)) // (l.n + l.v) AS q
  FROM groups_ g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), every AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
