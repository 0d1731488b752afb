"""Registered queries of this subpackage and, where SQL can say the same over whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mentionloom.llm import encode, frequency, leakage, overlap, residue, sentences, topn
from mentionloom.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    best = topn.top_items(table(spark, d, "cnn_candidates"), ["pmc_id", "identifier"], "candidate_id", "score", ["offset"], n=3, nullable=["pmc_id"])
    return best.select("candidate_id", "rank_no")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "passages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(table(spark, d, "cnn_candidates"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.split_overlaps(table(spark, d, "articles"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles")
    return overlap.overlap_report(articles, cut(overlap.split_overlaps(articles)))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p3_found": p3_found, "p6_found": p6_found, "p7_found": p7_found, "p7_report": p7_report, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            WITH once AS (SELECT candidate_id, any_value(pmc_id) AS pmc_id, any_value(identifier) AS identifier, any_value(score) AS score, any_value("offset") AS off
                          FROM cnn_candidates WHERE score IS NOT NULL AND NOT isnan(score) AND identifier IS NOT NULL GROUP BY candidate_id),
                 ranked AS (SELECT candidate_id, row_number() OVER (PARTITION BY pmc_id, identifier ORDER BY score DESC, off, candidate_id) AS r FROM once)
            SELECT candidate_id, CAST(r AS INTEGER) AS rank_no FROM ranked WHERE r <= 3""",
        # words without look-alikes, marks and entities: nearly equal texts are far over the threshold and others far under it
        "p7_found": r"""
            WITH a AS (SELECT article_row, coalesce(split = 'train', FALSE) AS train, ltrim(regexp_extract(pmc_id, '[0-9]{4,}'), '0') AS num, full_text FROM articles),
                 t AS (SELECT article_row, train, string_agg(x.text, ' ' ORDER BY i) AS txt FROM (SELECT article_row, train, i, full_text[i+1] AS x FROM a, unnest(range(len(full_text))) u(i)) GROUP BY ALL),
                 w AS (SELECT article_row, train, regexp_extract_all(lower(regexp_replace(txt, '</?[A-Za-z][^<>]{0,200}>', '', 'g')), '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{N}]+') AS w FROM t),
                 g AS (SELECT article_row, train, len(w) AS n, i, array_to_string(w[i+1:i+8], ' ') AS gram FROM w, unnest(range(len(w) - 7)) u(i)),
                 h AS (SELECT x.article_row AS o, y.article_row AS t, x.n AS no, y.n AS nt, x.i AS io, y.i AS it FROM g x JOIN g y ON x.gram = y.gram AND NOT x.train AND y.train),
                 co AS (SELECT o, t, count(DISTINCT p) / any_value(no) AS s FROM (SELECT DISTINCT o, t, no, unnest(range(io, io + 8)) AS p FROM h) GROUP BY o, t),
                 ct AS (SELECT o, t, count(DISTINCT p) / any_value(nt) AS s FROM (SELECT DISTINCT o, t, nt, unnest(range(it, it + 8)) AS p FROM h) GROUP BY o, t),
                 f AS (SELECT co.o, co.t FROM co JOIN ct ON ct.o = co.o AND ct.t = co.t WHERE least(co.s, ct.s) >= 0.65 UNION SELECT x.article_row, y.article_row FROM a x JOIN a y ON x.num = y.num AND x.num <> '' AND NOT x.train AND y.train)
            SELECT DISTINCT least(o, t) AS article_lo, greatest(o, t) AS article_hi FROM f""",
    }
