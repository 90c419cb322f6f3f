"""The columns of the quality and language-model operators that SQL gives too, as queries of their own beside the operators' whole results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import common as C
from pairloom.llm import hmm, quality


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures and base verdict of every document."""
    return quality.op1_quality(spark, sf_dir).drop("score", "kept")


def unigram_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the unigram score of every document, to three decimals."""
    return hmm.score(C.documents(spark, sf_dir), rounds=1).drop("score").withColumn("base_score", F.round("base_score", 3))


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
k AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS k FROM d WHERE len(w) >= 8),
s AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS n FROM k) WHERE n > 1),
c AS (SELECT rid, count(*) AS covered FROM (SELECT DISTINCT rid, i + o AS p FROM s, (SELECT unnest(range(8)) AS o)) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(covered, 0) AS n_repeat_words FROM d JOIN l USING (rid) LEFT JOIN c USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
"""
#: crc32 of the identifier as text, from its table of 256 remainders.
CRC = """WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
ids AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), tab)"""
UNIGRAM_SQL = CRC + r""",
d AS (SELECT row_number() OVER () AS rid, documents.doc_id, coalesce(crc, 0) % 7 = 2 AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w FROM documents LEFT JOIN ids ON ids.doc_id = documents.doc_id),
t AS (SELECT rid, held_out, unnest(w) AS tok FROM d), c AS (SELECT tok, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c),
s AS (SELECT rid, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / (n + v + 1)::DOUBLE)) AS base FROM (SELECT t.rid, c.c FROM t LEFT JOIN c USING (tok)), n GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 3) AS base_score FROM d JOIN s USING (rid), n
"""
