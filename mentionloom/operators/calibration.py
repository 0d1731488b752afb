"""Calibration examples for judging whether a value belongs to a patient: patients by values of the training articles, with short summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.functions import text as tx
from mentionloom.operators import batching, contexts, model_io, ontology, structure


def _joined(items: Column, by: str) -> Column:
    """Items of an array of (position, text) in order of position."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["t"]), by)


def patient_summaries(anchors: DataFrame, passages: DataFrame, patients: DataFrame, most_mentions: int = 6, most_contexts: int = 3, longest: int = 260) -> DataFrame:
    """(pmc_id, patient_ord, patient_id, summary): the first mentions with their offsets, and the first contexts, cut."""
    said = anchors.filter(F.col("m_ord") < most_mentions).groupBy("pmc_id", "patient_ord").agg(_joined(F.collect_list(F.struct("m_ord", F.concat(F.coalesce("m_text", F.lit("None")), F.lit("@"), "m_off").alias("t"))), ", ").alias("mentions"))
    w = Window.partitionBy("pmc_id", "patient_ord").orderBy("m_ord")
    shown = contexts.patient_contexts(anchors, passages).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most_contexts)
    near = shown.groupBy("pmc_id", "patient_ord").agg(_joined(F.collect_list(F.struct("r", F.substring(F.trim("context"), 1, longest).alias("t"))), " | ").alias("contexts"))
    rows = patients.join(said, ["pmc_id", "patient_ord"], "left").join(near, ["pmc_id", "patient_ord"], "left")
    text = F.concat(F.lit("mentions: "), F.coalesce("mentions", F.lit("")), F.lit("; contexts: "), F.coalesce("contexts", F.lit("")))
    return rows.select("pmc_id", "patient_ord", "patient_id", text.alias("summary"))


def occurrence_summaries(entities: DataFrame, passages: DataFrame, longest: int = 300) -> DataFrame:
    """(pmc_id, e_ord, summary): section, offset and the sentence of a mention, cut."""
    at = model_io.candidate_context(entities, passages)
    return at.select("pmc_id", "e_ord", F.concat(F.coalesce("section", F.lit("UNKNOWN")), F.lit("@"), "offset", F.lit(": "), F.substring("context", 1, longest)).alias("summary"))


def association_examples(entities: DataFrame, passages: DataFrame, anchors: DataFrame, patients: DataFrame, associations: DataFrame, terms: DataFrame, most: int = 2) -> DataFrame:
    """(pmc_id, patient_id, value, accepted, name, patient_context, occurrence_context, tie): every patient with every positive value of its article; accepted if the gold association says so."""
    positive = entities.filter(tx.is_positive(F.col("note")))
    values = positive.select("pmc_id", "e_ord", F.explode(F.filter(structure.single_values(F.col("identifier"), F.col("text")), lambda v: v != "")).alias("value")).distinct()
    first = contexts.first_occurrences(positive, most).select("pmc_id", "value", "e_ord", "rank_no")
    told = first.join(occurrence_summaries(positive, passages), ["pmc_id", "e_ord"]).groupBy("pmc_id", "value").agg(_joined(F.collect_list(F.struct("rank_no", F.col("summary").alias("t"))), " | ").alias("occurrence_context"))
    names = ontology.canonical(values.select("value").distinct(), terms, "value").join(terms.select(F.col("identifier").alias("canonical"), "name"), "canonical", "left").select("value", F.coalesce(F.nullif("name", F.lit("")), "value").alias("name"))
    gold = associations.select("pmc_id", "patient_id", "value").distinct().withColumn("accepted", F.lit(1))
    who = patient_summaries(anchors, passages, patients).select("pmc_id", "patient_id", F.col("summary").alias("patient_context"))
    rows = values.select("pmc_id", "value").distinct().join(who, "pmc_id").join(told, ["pmc_id", "value"], "left").join(names, "value", "left").join(gold, ["pmc_id", "patient_id", "value"], "left")
    rows = rows.withColumn("accepted", F.coalesce("accepted", F.lit(0))).withColumn("occurrence_context", F.coalesce("occurrence_context", F.lit("")))
    tie = batching.tie_break(*[F.col(c) for c in ("pmc_id", "value", "patient_context", "occurrence_context", "accepted")])
    return rows.withColumn("tie", tie).select("pmc_id", "patient_id", "value", "accepted", "name", "patient_context", "occurrence_context", "tie")


def select_examples(batches: DataFrame, examples: DataFrame, per_label: int) -> DataFrame:
    """(pmc_id, batch, accepted, rank_no, tie): for each batch of values the best examples of either label from other articles: those of its values first, then the greatest tie value.

    ``batches`` is (pmc_id, batch, value). An article gives at most ``per_label`` of what can win, so the best twice as many
    of a value, or of all, hold whatever article is left out: batches meet examples through equal values or a handful of rows.
    """

    def top(rows: DataFrame, *by: str) -> DataFrame:
        own = F.row_number().over(Window.partitionBy(*by, "accepted", "source").orderBy(F.desc("tie")))
        few = rows.withColumn("_r", own).filter(F.col("_r") <= per_label)
        return few.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "accepted").orderBy(F.desc("tie")))).filter(F.col("_r") <= 2 * per_label).drop("_r")

    pool = examples.select(F.col("pmc_id").alias("source"), "value", "accepted", "tie").distinct()
    keys = batches.select("pmc_id", "batch").distinct()
    hits = batches.select("pmc_id", "batch", "value").distinct().join(top(pool, "value"), "value").select("pmc_id", "batch", "source", "accepted", "tie", F.lit(1).alias("hit"))
    rest = keys.withColumn("k", F.lit(1)).join(F.broadcast(top(pool).withColumn("k", F.lit(1))), "k").select("pmc_id", "batch", "source", "accepted", "tie", F.lit(0).alias("hit"))  # at most four times per_label rows
    met = hits.unionByName(rest).filter("source <> pmc_id").groupBy("pmc_id", "batch", "accepted", "tie").agg(F.max("hit").alias("hit"))
    ranked = met.withColumn("rank_no", F.row_number().over(Window.partitionBy("pmc_id", "batch", "accepted").orderBy(F.desc("hit"), F.desc("tie"))))
    return ranked.filter(F.col("rank_no") <= per_label).select("pmc_id", "batch", "accepted", "rank_no", "tie")
