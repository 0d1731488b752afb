"""Queries around calls to a model: batches, chunks, calibration examples and requests, and the recovery of broken JSON.

There is no model here, so no query reads replies; what reads them is tested with given ones. Recovery runs over the article
lines as delivered, some of which are cut off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionloom.functions import text as tx
from mentionloom.operators import associations, batching, calibration, contexts, linking, model_io, structure
from mentionloom.plans import annotation_sql as sql
from mentionloom.plans.annotation import Tables, _ints, _rounded, registered
from mentionloom.session import table

BATCH = 5
PER_LABEL = 2
CHUNK = 700


def _batches(t: Tables) -> DataFrame:
    held_out = t.docs.filter("split IS DISTINCT FROM 'train'").select("pmc_id")
    rows = model_io.candidate_context(t.additions.join(held_out, "pmc_id", "left_semi").filter(tx.is_positive(F.col("note"))), t.passages)
    rows = rows.withColumn("e_ord", F.col("a_ord")).withColumn("surface", t.normalize(F.col("text"))).withColumn("section", F.coalesce("section", F.lit("UNKNOWN")))
    return batching.fixed_batches(rows, "pmc_id", ["a_ord"], BATCH)


def _examples(t: Tables) -> DataFrame:
    train = t.docs.filter("split = 'train'").select("pmc_id")
    gold = t.entities.filter(tx.is_positive(F.col("note"))).select("pmc_id", "offset", "length", "identifier").distinct().withColumn("g", F.lit(1))
    rows = model_io.candidate_context(t.annotations.join(train, "pmc_id", "left_semi").filter(tx.is_positive(F.col("note")) & F.col("text").isNotNull()), t.passages)
    rows = rows.join(gold, ["pmc_id", "offset", "length", "identifier"], "left").withColumn("accepted", F.coalesce("g", F.lit(0))).withColumn("section", F.coalesce("section", F.lit("UNKNOWN")))
    tie = batching.tie_break(F.col("section"), F.col("text"), F.col("identifier"), F.col("pmc_id"), F.col("e_ord"), F.col("accepted"))
    return rows.select("section", "identifier", "accepted", t.normalize(F.col("text")).alias("surface"), tie.alias("tie"))


def candidate_batches(t: Tables) -> DataFrame:
    return _ints(_batches(t).select("pmc_id", "a_ord", "batch", "index", "section", "context"), "a_ord", "batch", "index")


def passage_chunks(t: Tables) -> DataFrame:
    return _ints(batching.greedy_chunks(t.passages, "pmc_id", "p_idx", F.length("text") + 100, CHUNK), "p_idx", "chunk")


def calibration_topk(t: Tables) -> DataFrame:
    rows = batching.calibration_examples(_batches(t), _examples(t), PER_LABEL)
    return _ints(rows, "batch", "accepted", "rank_no")


def model_requests(t: Tables) -> DataFrame:
    batches = _batches(t)
    rows = model_io.judge_requests(batches, batching.calibration_examples(batches, _examples(t), PER_LABEL))
    return rows.select("pmc_id", "batch", F.size("candidates").alias("n_candidates"), F.size("calibration").alias("n_examples"), "key", F.length("payload").alias("size"))


def value_requests(t: Tables) -> DataFrame:
    near = contexts.nearest_occurrences(t.entities, t.anchors, t.patients)
    rows = model_io.value_requests(model_io.value_batches(t.entities, BATCH), near, contexts.marked_contexts(t.entities, t.passages), t.patients)
    return rows.select("pmc_id", "patient_id", "batch", F.size("values").alias("n_values"), "key", F.length("payload").alias("size"))


def _association_examples(t: Tables) -> DataFrame:
    return calibration.association_examples(t.entities, t.passages, t.anchors, t.patients, t.associations, t.terms)


def association_examples(t: Tables) -> DataFrame:
    return _association_examples(t)


def association_calibration(t: Tables) -> DataFrame:
    """For each batch of an article's values the examples that a judge would be shown."""
    return _ints(calibration.select_examples(model_io.value_batches(t.entities, BATCH), _association_examples(t), PER_LABEL), "batch", "accepted", "rank_no")


def joint_and_near(t: Tables) -> DataFrame:
    """Values that a wide reading of the article's structure gives to a patient and the nearest patient confirms."""
    wide = structure.structural_patients(t.entities, t.passages, t.anchors, previous_distance=6000, next_distance=600)
    return _ints(associations.confirmed(model_io.values_of(wide, t.entities), t.near), "v_ord")


def json_recovery(t: Tables) -> DataFrame:
    """What is left of every article line, whole or cut off: its record's number and the members of its lists."""
    lines = table(t.spark, t.d, "raw_articles").select("line_no", model_io.recovered(F.col("payload")).alias("json")).filter("json IS NOT NULL")
    size = lambda name: F.coalesce(F.size(F.from_json(F.get_json_object("json", f"$.{name}"), "array<string>")), F.lit(0)).alias(name)
    return lines.select("line_no", F.get_json_object("json", "$.pmc_id").alias("pmc_id"), size("full_text"), size("entities"), size("patient"), size("association"))


def value_batches(t: Tables) -> DataFrame:
    return _ints(model_io.value_batches(t.entities, BATCH), "v_ord", "batch", "index")


def consensus_associations(t: Tables) -> DataFrame:
    """Mentions that either of two window settings supports for a patient, as values."""
    near = structure.structural_patients(t.entities, t.passages, t.anchors, previous_distance=3000, next_distance=500)
    joint = structure.structural_patients(t.entities, t.passages, t.anchors, previous_distance=3000, next_distance=300)
    return _ints(model_io.values_of(model_io.consensus(near, joint), t.entities), "v_ord")


def fuzzy_link(t: Tables) -> DataFrame:
    unmapped = t.entities.filter("identifier = '-1'").select(t.normalize(F.col("text")).alias("surface"))
    return _rounded(linking.fuzzy_link(unmapped, t.dictionary))


def finding_ids(t: Tables) -> DataFrame:
    """The findings of all annotators with the single id that they give, linked anew."""
    text = t.normalize(F.col("text"))
    rows = t.annotations.filter("text IS NOT NULL").select(F.col("e_ord").alias("finding_id"), text.alias("text"), F.lit("").alias("canonical"), F.when(F.col("identifier").rlike("^HP:[0-9]+$"), F.col("identifier")).alias("supplied"))
    return linking.finding_identifiers(rows, t.aliases, t.dictionary, contexts.majority_ids(t.entities, t.normalize))


_QUERIES = [candidate_batches, passage_chunks, calibration_topk, model_requests, value_requests, value_batches, association_examples, association_calibration, joint_and_near, json_recovery, consensus_associations, fuzzy_link, finding_ids]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registered(_QUERIES, set(oracle_sql()), [candidate_batches, calibration_topk])


_PLACED = "SELECT x.*, coalesce(p.section, 'UNKNOWN') AS section, p.p_idx, p.p_off, p.text AS p_text FROM {0} x LEFT JOIN psg p ON p.pmc_id = x.pmc_id AND p.p_off <= x.off AND x.off < p.p_end QUALIFY row_number() OVER (PARTITION BY x.pmc_id, x.{1} ORDER BY p.p_idx) = 1"
_CONTEXT = rf"left(regexp_replace(trim(substring(p_text, length(regexp_extract(left(p_text, off - p_off), '(?s)^.*[.!?;\n]')) + 1, off - p_off + len + length(regexp_extract(substring(p_text, off - p_off + len + 1), '(?s)^[^.!?;\n]*[.!?;\n]?')) - length(regexp_extract(left(p_text, off - p_off), '(?s)^.*[.!?;\n]')))), '{sql._BLANK}', ' ', 'g'), 360)"
_PARTS = {
    "a0": "SELECT a.* FROM adds a SEMI JOIN (SELECT pmc_id FROM docs WHERE split IS DISTINCT FROM 'train') d ON d.pmc_id = a.pmc_id WHERE a.note IS DISTINCT FROM 'NO'",
    "b0": _PLACED.format("a0", "a_ord"),
    "bt": f"SELECT *, (row_number() OVER (PARTITION BY pmc_id ORDER BY a_ord) - 1) // {BATCH} AS batch, (row_number() OVER (PARTITION BY pmc_id ORDER BY a_ord) - 1) % {BATCH} AS idx, {sql._norm('text')} AS surface FROM b0",
    "e0": "SELECT a.* FROM ann a SEMI JOIN (SELECT pmc_id FROM docs WHERE split = 'train') d ON d.pmc_id = a.pmc_id WHERE a.note IS DISTINCT FROM 'NO' AND a.text IS NOT NULL",
    "e1": _PLACED.format("e0", "e_ord"),
    "e2": "SELECT e.*, CASE WHEN EXISTS (SELECT 1 FROM ent g WHERE g.note IS DISTINCT FROM 'NO' AND g.pmc_id = e.pmc_id AND g.off = e.off AND g.len = e.len AND g.identifier = e.identifier) THEN 1 ELSE 0 END AS accepted FROM e1 e",
    "ex": f"SELECT *, {sql._norm('text')} AS surface, sha256(concat_ws(chr(31), section, text, identifier, pmc_id, CAST(e_ord AS VARCHAR), CAST(accepted AS VARCHAR))) AS tie FROM e2",
}


_EXAMPLE_NEEDS = "ent loc anc psg pat aso trm prim"
_EXAMPLES = {
    "pc": f"SELECT a.pmc_id, a.patient_ord, a.m_ord, trim(regexp_replace(substring(text, greatest(m_off - p_off - 120, 0) + 1, least(length(text), m_off - p_off + coalesce(m_len, 0) + 180) - greatest(m_off - p_off - 120, 0)), '{sql._BLANK}', ' ', 'g')) AS context FROM anc a JOIN psg p ON p.pmc_id = a.pmc_id AND p.p_off <= a.m_off AND a.m_off < p.p_end QUALIFY row_number() OVER (PARTITION BY a.pmc_id, a.patient_ord, a.m_ord ORDER BY p.p_idx) = 1",
    "p3": "SELECT pmc_id, patient_ord, string_agg(left(context, 260), ' | ' ORDER BY m_ord) AS contexts FROM (SELECT *, row_number() OVER (PARTITION BY pmc_id, patient_ord ORDER BY m_ord) AS r FROM pc) WHERE r <= 3 GROUP BY ALL",
    "m6": "SELECT pmc_id, patient_ord, string_agg(coalesce(m_text, 'None') || '@' || m_off, ', ' ORDER BY m_ord) AS mentions FROM anc WHERE m_ord < 6 GROUP BY ALL",
    "who": "SELECT p.pmc_id, p.patient_id, 'mentions: ' || coalesce(mentions, '') || '; contexts: ' || coalesce(contexts, '') AS patient_context FROM pat p LEFT JOIN m6 ON m6.pmc_id = p.pmc_id AND m6.patient_ord = p.patient_ord LEFT JOIN p3 ON p3.pmc_id = p.pmc_id AND p3.patient_ord = p.patient_ord",
    "os": f"SELECT pmc_id, e_ord, section || '@' || off || ': ' || left(coalesce({_CONTEXT}, ''), 300) AS summary FROM (SELECT * REPLACE (coalesce(section, 'UNKNOWN') AS section) FROM loc WHERE note IS DISTINCT FROM 'NO')",
    "ev": f"SELECT DISTINCT pmc_id, e_ord, value FROM (SELECT pmc_id, e_ord, unnest({sql._UNITS}) AS value FROM ent WHERE note IS DISTINCT FROM 'NO') WHERE value <> ''",
    "oc": "SELECT v.pmc_id, v.value, string_agg(o.summary, ' | ' ORDER BY r) AS occurrence_context FROM (SELECT *, row_number() OVER (PARTITION BY pmc_id, value ORDER BY e_ord) AS r FROM ev) v JOIN os o ON o.pmc_id = v.pmc_id AND o.e_ord = v.e_ord WHERE r <= 2 GROUP BY ALL",
    "x0": "SELECT v.pmc_id, w.patient_id, v.value, CASE WHEN g.value IS NULL THEN 0 ELSE 1 END AS accepted, w.patient_context, coalesce(c.occurrence_context, '') AS occurrence_context FROM (SELECT DISTINCT pmc_id, value FROM ev) v JOIN who w ON w.pmc_id = v.pmc_id LEFT JOIN oc c ON c.pmc_id = v.pmc_id AND c.value = v.value LEFT JOIN (SELECT DISTINCT pmc_id, patient_id, value FROM aso) g ON g.pmc_id = v.pmc_id AND g.patient_id = w.patient_id AND g.value = v.value",
    "xm": "SELECT x.pmc_id, patient_id, x.value, accepted, coalesce(nullif(n.name, ''), x.value) AS name, patient_context, occurrence_context, sha256(concat_ws(chr(31), x.pmc_id, x.value, patient_context, occurrence_context, CAST(accepted AS VARCHAR))) AS tie FROM x0 x LEFT JOIN prim p ON p.alt = x.value LEFT JOIN trm t ON t.identifier = coalesce(p.main, x.value) AND t.obsolete AND t.replaced_by IS NOT NULL LEFT JOIN trm n ON n.identifier = coalesce(t.replaced_by, coalesce(p.main, x.value))",
}


def oracle_sql() -> dict[str, str]:
    b = {k: _PARTS[k] for k in ("a0", "b0", "bt")}
    e = {k: _PARTS[k] for k in ("e0", "e1", "e2", "ex")}
    return {
        "candidate_batches": sql._with("adds psg docs", f"SELECT pmc_id, CAST(a_ord AS BIGINT) AS a_ord, CAST(batch AS BIGINT) AS batch, CAST(idx AS BIGINT) AS index, section, coalesce({_CONTEXT}, '') AS context FROM bt", **b),
        "passage_chunks": sql._with("psg", "SELECT pmc_id, CAST(p_idx AS BIGINT) AS p_idx, CAST(chunk AS BIGINT) AS chunk FROM w", recursive=True,
            n="SELECT pmc_id, p_idx, length(text) + 100 AS s, row_number() OVER (PARTITION BY pmc_id ORDER BY p_idx) AS r FROM psg",
            w=f"SELECT pmc_id, p_idx, r, 0 AS chunk, s AS used FROM n WHERE r = 1 UNION ALL SELECT n.pmc_id, n.p_idx, n.r, CASE WHEN w.used + n.s > {CHUNK} THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.used + n.s > {CHUNK} THEN n.s ELSE w.used + n.s END FROM w JOIN n ON n.pmc_id = w.pmc_id AND n.r = w.r + 1"),
        "calibration_topk": sql._with("adds psg docs ann ent", f"SELECT pmc_id, CAST(batch AS BIGINT) AS batch, CAST(accepted AS BIGINT) AS accepted, rank_no, tie FROM (SELECT *, row_number() OVER (PARTITION BY pmc_id, batch, accepted ORDER BY list_contains(ss, surface) DESC, list_has_any(ii, string_split(identifier, ';')) DESC, list_contains(cc, section) DESC, tie DESC) AS rank_no FROM t CROSS JOIN (SELECT surface, identifier, section, accepted, tie FROM ex)) WHERE rank_no <= {PER_LABEL}",
            **b, **e, t="SELECT pmc_id, batch, list(DISTINCT surface) AS ss, list(DISTINCT section) AS cc, flatten(list(string_split(identifier, ';'))) AS ii FROM bt GROUP BY pmc_id, batch"),
        "association_examples": sql._with(_EXAMPLE_NEEDS, "SELECT pmc_id, patient_id, value, accepted, name, patient_context, occurrence_context, tie FROM xm", **_EXAMPLES),
        "association_calibration": sql._with(_EXAMPLE_NEEDS, f"SELECT pmc_id, batch, CAST(accepted AS BIGINT) AS accepted, r AS rank_no, tie FROM (SELECT *, row_number() OVER (PARTITION BY pmc_id, batch, accepted ORDER BY hit DESC, tie DESC) AS r FROM (SELECT DISTINCT b.pmc_id, b.batch, x.accepted, x.tie, CASE WHEN list_contains(b.vs, x.value) THEN 1 ELSE 0 END AS hit FROM bv b JOIN xm x ON x.pmc_id <> b.pmc_id)) WHERE r <= {PER_LABEL}", **_EXAMPLES,
            vo=sql._GROUP_PARTS["vo"], bv=f"SELECT pmc_id, (o - 1) // {BATCH} AS batch, list(value) AS vs FROM vo GROUP BY ALL"),
        "joint_and_near": sql._with("snt aloc ent near", "SELECT pmc_id, patient_id, row_number() OVER (PARTITION BY pmc_id, patient_id ORDER BY v_ord) - 1 AS v_ord, value FROM jv v SEMI JOIN near n ON n.pmc_id = v.pmc_id AND n.patient_id = v.patient_id AND n.value = v.value",
            w=sql._PARTS["strp"].replace("@P@", "6000").replace("@N@", "600"), jv=sql._seen("(SELECT w.pmc_id, w.patient_id, CASE WHEN identifier = '-1' THEN coalesce(text, '') ELSE identifier END AS value, off, e.e_ord FROM w JOIN ent e ON e.pmc_id = w.pmc_id AND e.e_ord = w.e_ord)", "off e_ord")),
        "value_batches": sql._with("ent", f"SELECT pmc_id, value, o - 1 AS v_ord, (o - 1) // {BATCH} AS batch, (o - 1) % {BATCH} AS index FROM vo", vo=sql._GROUP_PARTS["vo"]),
        "consensus_associations": sql._with("snt aloc ent", sql._seen("(SELECT w.pmc_id, w.patient_id, CASE WHEN identifier = '-1' THEN coalesce(text, '') ELSE identifier END AS value, off, e.e_ord FROM w JOIN ent e ON e.pmc_id = w.pmc_id AND e.e_ord = w.e_ord)", "off e_ord"), w=sql._PARTS["strp"].replace("@P@", "3000").replace("@N@", "500")),
    }
