"""What a model or a reader is shown of an article: contexts, occurrences, names and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.functions import text as tx
from mentionloom.operators.entity_sets import locate
from mentionloom.operators.structure import single_values


def _flat(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def patient_contexts(anchors: DataFrame, passages: DataFrame, before: int = 120, after: int = 180) -> DataFrame:
    """(pmc_id, patient_ord, m_ord, context): the text around each patient mention, white space collapsed; mentions outside passages have none."""
    at = locate(anchors, passages, "m_off").filter("p_idx is not null")
    start = F.col("m_off") - F.col("p_off")
    left, right = F.greatest(start - before, F.lit(0)), F.least(F.length("p_text"), start + F.coalesce("m_len", F.lit(0)) + after)
    return at.select("pmc_id", "patient_ord", "m_ord", _flat(tx.slice_text(F.col("p_text"), left, right)).alias("context"))


def marked_contexts(entities: DataFrame, passages: DataFrame, radius: int = 150) -> DataFrame:
    """(pmc_id, e_ord, section, context): the mention in double square brackets within its surroundings; outside passages ``UNKNOWN`` and the mention's own text."""
    at = locate(entities, passages)
    text, start = F.col("p_text"), F.col("offset") - F.col("p_off")
    end = start + F.col("length")
    shown = F.concat(tx.slice_text(text, F.greatest(start - radius, F.lit(0)), start), F.lit("[["), tx.slice_text(text, start, end), F.lit("]]"), tx.slice_text(text, end, end + radius))
    return at.select("pmc_id", "e_ord", F.coalesce("section", F.lit("UNKNOWN")).alias("section"), F.coalesce(F.trim(_flat(shown)), "text", F.lit("")).alias("context"))


def display_names(ids: DataFrame, terms: DataFrame, column: str = "identifier") -> DataFrame:
    """``ids`` with ``names``: the names of the single ids in their order, joined by ``; ``; unknown ids stand for themselves."""
    parts = ids.select(column).distinct().select(column, F.posexplode(F.split(column, ";")).alias("i", "unit"))
    named = parts.join(terms.select(F.col("identifier").alias("unit"), "name"), "unit", "left")
    per = named.groupBy(column).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("name", "unit").alias("n")))), lambda x: x["n"]), "; ").alias("names"))
    return ids.join(per, column, "left")


def nearest_occurrences(entities: DataFrame, anchors: DataFrame, patients: DataFrame, most: int = 3) -> DataFrame:
    """(pmc_id, patient_id, value, e_ord, rank_no): of each value the occurrences nearest to a mention of the patient, then by offset."""
    e = entities.filter(tx.is_positive(F.col("note"))).select("pmc_id", "e_ord", "offset", F.explode(single_values(F.col("identifier"), F.col("text"))).alias("value"))
    who = patients.select("pmc_id", "patient_id").distinct().join(anchors.select("pmc_id", "patient_id", "m_off"), ["pmc_id", "patient_id"], "left")
    gap = F.min(F.coalesce(F.abs(F.col("offset") - F.col("m_off")).cast("bigint"), F.lit(10**12)))
    near = e.join(who, "pmc_id").groupBy("pmc_id", "patient_id", "value", "e_ord", "offset").agg(gap.alias("gap"))
    w = Window.partitionBy("pmc_id", "patient_id", "value").orderBy("gap", "offset", "e_ord")
    return near.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= most).select("pmc_id", "patient_id", "value", "e_ord", "rank_no")


def first_occurrences(entities: DataFrame, most: int = 2) -> DataFrame:
    """(pmc_id, value, e_ord, rank_no): the first mentions of each value of an article."""
    e = entities.filter(tx.is_positive(F.col("note"))).select("pmc_id", "e_ord", F.explode(F.array_distinct(single_values(F.col("identifier"), F.col("text")))).alias("value"))
    w = Window.partitionBy("pmc_id", "value").orderBy("e_ord")
    return e.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= most)


def passage_examples(targets: DataFrame, gold_passages: DataFrame, most: int = 5, longest: int = 1800) -> DataFrame:
    """(pmc_id, p_idx, example_pmc, example_idx, rank_no): for each target passage the first annotated passages of its section in other articles.

    ``gold_passages`` has pmc_id, p_idx, section, text and n (its mentions). Only the first few of a section can be chosen,
    whatever article is left out, so targets meet a bounded pool.
    """
    usable = gold_passages.filter((F.col("n") > 0) & (F.length("text") <= longest) & F.col("section").isNotNull())
    per = Window.partitionBy("section").orderBy("pmc_id", "p_idx")
    own = F.count("*").over(Window.partitionBy("section", "pmc_id"))
    ranked = usable.select(F.col("pmc_id").alias("example_pmc"), F.col("p_idx").alias("example_idx"), "section", F.row_number().over(per).alias("r"), own.alias("own"))
    widest = ranked.groupBy("section").agg(F.max("own").alias("widest"))
    pool = ranked.join(widest, "section").filter(F.col("r") <= most + F.col("widest")).select("example_pmc", "example_idx", "section", "r")
    met = targets.select("pmc_id", "p_idx", "section").join(pool, "section").filter("example_pmc <> pmc_id")
    w = Window.partitionBy("pmc_id", "p_idx").orderBy("r")
    return met.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= most).select("pmc_id", "p_idx", "example_pmc", "example_idx", "rank_no")


def majority_ids(entities: DataFrame, normalize) -> DataFrame:
    """(surface, identifier, n, total): the most frequent identifier of positive mentions where it has at least half of them; ``-1`` is none."""
    e = entities.filter(tx.is_positive(F.col("note")) & F.col("text").isNotNull() & F.col("identifier").isNotNull()).withColumn("surface", normalize(F.col("text")))
    counts = e.groupBy("surface", "identifier").agg(F.count("*").alias("n"), F.min(F.struct("pmc_id", "e_ord")).alias("seen"))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy("surface")))
    w = Window.partitionBy("surface").orderBy(F.desc("n"), "seen")
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1 AND 2 * n >= total AND identifier <> '-1'").select("surface", "identifier", "n", "total")


def summary_counts(entities: DataFrame, associations: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: articles, mentions, negative mentions, association values."""
    one = F.lit(1).alias("k")
    d = docs.agg(F.count("*").alias("documents")).select(one, "documents")
    e = entities.agg(F.count("*").alias("entities"), F.sum((~tx.is_positive(F.col("note"))).cast("bigint")).alias("negative")).select(one, "entities", "negative")
    v = associations.agg(F.count("*").alias("association_values")).select(one, "association_values")
    return d.join(e, "k").join(v, "k").drop("k")
