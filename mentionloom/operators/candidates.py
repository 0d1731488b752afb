"""Scored candidates: surface precision, leave-one-out precision, filters, caps and fusion with a base.

Candidates are (pmc_id, c_ord, identifier, type, offset, length, text, note, score); surfaces are normalised by a column
function. A null or NaN score fails every threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.functions.text import is_positive, normalize_surface
from mentionloom.operators import entity_sets as es


@dataclass(frozen=True)
class CandidateRules:
    min_score: float = 0.9997
    min_text_length: int = 6
    max_per_identifier: int = 10
    avoid_overlap: bool = True
    new_identifiers_only: bool = False
    surface_min_precision: float = 0.0
    surface_min_count: int = 1


def surface_counts(candidates: DataFrame, gold: DataFrame, normalize: Callable[[Column], Column] = normalize_surface) -> DataFrame:
    """(pmc_id, surface, tp, total): hits are candidates whose (offset, length, identifier) is a positive gold mention of an article that has gold."""
    hits = gold.filter(is_positive(F.col("note"))).select("pmc_id", "offset", "length", "identifier").distinct().withColumn("hit", F.lit(1))
    named = candidates.join(gold.select("pmc_id").distinct(), "pmc_id", "left_semi").filter("text is not null").withColumn("surface", normalize(F.col("text"))).filter("surface <> ''")
    flagged = named.join(hits, ["pmc_id", "offset", "length", "identifier"], "left")
    return flagged.groupBy("pmc_id", "surface").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("tp"), F.count("*").alias("total"))


def surface_precision(counts: DataFrame, min_count: int = 1) -> DataFrame:
    """(surface, precision, total)"""
    total = counts.groupBy("surface").agg(F.sum("tp").alias("tp"), F.sum("total").alias("total")).filter(F.col("total") >= min_count)
    return total.select("surface", (F.col("tp") / F.col("total")).alias("precision"), "total")


def surface_precision_left_out(counts: DataFrame, min_count: int = 1) -> DataFrame:
    """(pmc_id, surface, precision, total) from all other articles: totals less the article's own counts, no rebuild per article."""
    every = counts.groupBy("surface").agg(F.sum("tp").alias("_tp"), F.sum("total").alias("_n"))
    others = counts.join(every, "surface").select("pmc_id", "surface", (F.col("_tp") - F.col("tp")).alias("tp"), (F.col("_n") - F.col("total")).alias("total")).filter(F.col("total") >= max(min_count, 1))
    return others.select("pmc_id", "surface", (F.col("tp") / F.col("total")).alias("precision"), "total")


def additions(base: DataFrame, candidates: DataFrame, rules: CandidateRules, precision: DataFrame | None = None, normalize: Callable[[Column], Column] = normalize_surface) -> DataFrame:
    """Candidates that pass the rules and are not in ``base``, at most so many per article and identifier, ordered by span and identifier.

    ``precision`` has surface and precision, and pmc_id where it differs by article; surfaces it lacks pass.
    """
    rows = candidates.filter((F.col("score") >= rules.min_score) & ~F.isnan("score") & (F.length(F.coalesce("text", F.lit(""))) >= rules.min_text_length) & F.col("identifier").isNotNull())
    if precision is not None and rules.surface_min_count > 0:
        keys = ["pmc_id", "surface"] if "pmc_id" in precision.columns else ["surface"]
        rows = rows.withColumn("surface", normalize(F.col("text"))).join(precision.select(*keys, "precision"), keys, "left").filter(F.coalesce(F.col("precision") >= rules.surface_min_precision, F.lit(True))).drop("surface", "precision")
    rows = rows.alias("c").join(base.select(*es.KEY).alias("b"), es.same_key("c", "b"), "left_anti")
    if rules.avoid_overlap:
        rows = es.not_overlapping(rows, base)
    if rules.new_identifiers_only:
        rows = rows.join(base.select("pmc_id", "identifier").distinct(), ["pmc_id", "identifier"], "left_anti")
    w = Window.partitionBy("pmc_id", "identifier").orderBy(F.desc("score"), F.desc(F.length("text")), "offset", "c_ord")
    kept = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= rules.max_per_identifier)
    order = Window.partitionBy("pmc_id").orderBy("offset", "length", "identifier", "c_ord")
    return kept.withColumn("a_ord", F.row_number().over(order) - 1).drop("_r")


def fuse(base: DataFrame, added: DataFrame) -> DataFrame:
    """Base mentions untouched, then the additions without score."""
    n = base.groupBy("pmc_id").agg((F.max("e_ord") + 1).alias("n"))
    tail = added.join(n, "pmc_id", "left").select("pmc_id", (F.coalesce("n", F.lit(0)) + F.col("a_ord")).cast("int").alias("e_ord"), "identifier", F.lit("Phenotype").alias("type"), "offset", "length", "text", "note")
    return base.select("pmc_id", "e_ord", "identifier", "type", "offset", "length", "text", "note").unionByName(tail)
