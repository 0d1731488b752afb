"""Queries of the context operators, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.operators import contexts
from mentionloom.operators.entity_sets import locate
from mentionloom.plans import annotation_sql as sql
from mentionloom.plans.annotation import Tables, _ints, registered


def patient_contexts(t: Tables) -> DataFrame:
    return _ints(contexts.patient_contexts(t.anchors, t.passages), "patient_ord", "m_ord")


def marked_contexts(t: Tables) -> DataFrame:
    return _ints(contexts.marked_contexts(t.entities, t.passages), "e_ord")


def display_names(t: Tables) -> DataFrame:
    return contexts.display_names(t.entities.select("identifier").distinct(), t.terms)


def nearest_occurrences(t: Tables) -> DataFrame:
    return _ints(contexts.nearest_occurrences(t.entities, t.anchors, t.patients), "e_ord", "rank_no")


def first_occurrences(t: Tables) -> DataFrame:
    return _ints(contexts.first_occurrences(t.entities), "e_ord", "rank_no")


def passage_examples(t: Tables) -> DataFrame:
    held = locate(t.entities, t.passages).filter("p_idx is not null").groupBy("pmc_id", "p_idx").agg(F.count("*").alias("n"))
    gold = t.passages.join(held, ["pmc_id", "p_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _ints(contexts.passage_examples(t.passages, gold), "p_idx", "example_idx", "rank_no")


def majority_ids(t: Tables) -> DataFrame:
    return contexts.majority_ids(t.entities, t.normalize)


def summary_counts(t: Tables) -> DataFrame:
    return contexts.summary_counts(t.entities, t.associations, t.docs)


_QUERIES = [patient_contexts, marked_contexts, display_names, nearest_occurrences, first_occurrences, passage_examples, majority_ids, summary_counts]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registered(_QUERIES, set(oracle_sql()), [majority_ids])


def oracle_sql() -> dict[str, str]:
    blank = sql._BLANK
    values = f"SELECT pmc_id, e_ord, off, unnest({sql._UNITS}) AS value FROM ent WHERE note IS DISTINCT FROM 'NO'"
    return {
        "patient_contexts": sql._with("anc psg", f"SELECT pmc_id, CAST(patient_ord AS BIGINT) AS patient_ord, CAST(m_ord AS BIGINT) AS m_ord, regexp_replace(substring(text, greatest(m_off - p_off - 120, 0) + 1, least(length(text), m_off - p_off + coalesce(m_len, 0) + 180) - greatest(m_off - p_off - 120, 0)), '{blank}', ' ', 'g') AS context FROM (SELECT a.*, p.p_off, p.text FROM anc a JOIN psg p ON p.pmc_id = a.pmc_id AND p.p_off <= a.m_off AND a.m_off < p.p_end QUALIFY row_number() OVER (PARTITION BY a.pmc_id, a.patient_ord, a.m_ord ORDER BY p.p_idx) = 1)"),
        "marked_contexts": sql._with("loc", f"SELECT pmc_id, CAST(e_ord AS BIGINT) AS e_ord, coalesce(section, 'UNKNOWN') AS section, coalesce(trim(regexp_replace(substring(p_text, greatest(off - p_off - 150, 0) + 1, off - p_off - greatest(off - p_off - 150, 0)) || '[[' || substring(p_text, off - p_off + 1, len) || ']]' || substring(p_text, off - p_off + len + 1, 150), '{blank}', ' ', 'g')), text, '') AS context FROM loc"),
        "display_names": sql._with("ent trm", "SELECT x.identifier, string_agg(coalesce(t.name, x.u), '; ' ORDER BY i) AS names FROM (SELECT identifier, i, us[i+1] AS u FROM (SELECT DISTINCT identifier, string_split(identifier, ';') AS us FROM ent), unnest(range(len(us))) q(i)) x LEFT JOIN trm t ON t.identifier = x.u GROUP BY x.identifier"),
        "nearest_occurrences": sql._with("ent ids anc", "SELECT pmc_id, patient_id, value, CAST(e_ord AS BIGINT) AS e_ord, r AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY pmc_id, patient_id, value ORDER BY gap, off, e_ord) AS r FROM g) WHERE r <= 3",
            v=values, g="SELECT v.pmc_id, i.patient_id, v.value, v.e_ord, v.off, min(coalesce(abs(v.off - a.m_off), 1000000000000)) AS gap FROM v JOIN ids i ON i.pmc_id = v.pmc_id LEFT JOIN anc a ON a.pmc_id = i.pmc_id AND a.patient_id = i.patient_id GROUP BY ALL"),
        "first_occurrences": sql._with("ent", "SELECT pmc_id, value, CAST(e_ord AS BIGINT) AS e_ord, r AS rank_no FROM (SELECT pmc_id, value, e_ord, row_number() OVER (PARTITION BY pmc_id, value ORDER BY e_ord) AS r FROM (SELECT DISTINCT pmc_id, e_ord, value FROM v)) WHERE r <= 2", v=values),
        "passage_examples": sql._with("loc psg", "SELECT pmc_id, CAST(p_idx AS BIGINT) AS p_idx, example_pmc, CAST(example_idx AS BIGINT) AS example_idx, r AS rank_no FROM (SELECT t.pmc_id, t.p_idx, x.pmc_id AS example_pmc, x.p_idx AS example_idx, row_number() OVER (PARTITION BY t.pmc_id, t.p_idx ORDER BY x.pmc_id, x.p_idx) AS r FROM psg t JOIN u x ON x.section = t.section AND x.pmc_id <> t.pmc_id) WHERE r <= 5",
            u="SELECT * FROM psg p WHERE section IS NOT NULL AND length(text) <= 1800 AND EXISTS (SELECT 1 FROM loc l WHERE l.pmc_id = p.pmc_id AND l.p_idx = p.p_idx)"),
        "majority_ids": sql._with("srf", "SELECT surface, identifier, n, CAST(total AS BIGINT) AS total FROM (SELECT surface, identifier, n, sum(n) OVER (PARTITION BY surface) AS total, row_number() OVER (PARTITION BY surface ORDER BY n DESC, seen) AS r FROM (SELECT surface, identifier, count(*) AS n, min({'p': pmc_id, 'e': e_ord}) AS seen FROM srf WHERE note IS DISTINCT FROM 'NO' AND identifier IS NOT NULL GROUP BY ALL)) WHERE r = 1 AND 2 * n >= total AND identifier <> '-1'"),
        "summary_counts": sql._with("docs ent aso", "SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM ent WHERE note = 'NO') AS negative, (SELECT count(*) FROM aso) AS association_values"),
    }
