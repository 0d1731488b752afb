"""Fusion of patient-value tables (pmc_id, patient_id, v_ord, value).

Order is part of the result: values keep the order of the first source that has them. Patients come from the patients
table; values of other patients are left out where the article's patients are the frame.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.functions import text as tx
from mentionloom.operators import entity_sets as es
from mentionloom.operators import structure

_VALUE = ["pmc_id", "patient_id", "value"]


def entity_values(entities: DataFrame, whole: bool) -> DataFrame:
    """Distinct (pmc_id, value) of positive mentions: text where unmapped, else the single ids, and the whole id if asked for."""
    e = entities.filter(tx.is_positive(F.col("note")))
    single = structure.single_values(F.col("identifier"), F.col("text"))
    values = F.concat(single, F.array(F.col("identifier"))) if whole else single
    values = F.when(F.col("identifier") == "-1", single).otherwise(values)
    return e.select("pmc_id", F.explode(values).alias("value")).distinct()


def clip(associations: DataFrame, entities: DataFrame) -> DataFrame:
    """Values that the positive mentions hold, whole or split."""
    return associations.join(entity_values(entities, whole=True), ["pmc_id", "value"], "left_semi").select(*associations.columns)


def confirmed(associations: DataFrame, other: DataFrame) -> DataFrame:
    """Values of a patient that another assignment gives to the patient too, numbered anew in their own order."""
    kept = associations.join(other.select(*_VALUE), _VALUE, "left_semi")
    return structure.first_seen(kept, ["v_ord"])


def _tagged(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select(*_VALUE, F.col("v_ord").alias("ord"), F.lit(i).alias("source")) for i, t in enumerate(tables)])


def fuse_by_patient_count(patients: DataFrame, primary: DataFrame, secondary: DataFrame, union_multi: bool = False, union_range: tuple[int, int] | None = None, outside_primary: bool = False, max_ratio: float | None = None) -> DataFrame:
    """Union for articles with one patient, secondary alone for others; a range of patient counts or ``union_multi`` widens the union.

    With ``outside_primary`` articles outside the range keep the primary; a patient whose distinct primary values reach
    ``max_ratio`` times its secondary ones keeps the secondary.
    """
    if union_range is not None and not 1 <= union_range[0] <= union_range[1]:
        raise ValueError("union patient count range must satisfy 1 <= minimum <= maximum")
    if max_ratio is not None and max_ratio <= 0:
        raise ValueError("primary-to-secondary ratio must be positive")
    n = F.count("*").over(Window.partitionBy("pmc_id"))
    frame = patients.select("pmc_id", "patient_id", n.alias("n")).distinct()
    rows = _tagged([primary, secondary]).join(frame, ["pmc_id", "patient_id"])
    per = rows.groupBy(*_VALUE, "n").agg(F.min(F.struct("source", "ord")).alias("_o"), F.max((F.col("source") == 0).cast("int")).alias("in_p"), F.max((F.col("source") == 1).cast("int")).alias("in_s"))
    w = Window.partitionBy("pmc_id", "patient_id")
    per = per.withColumn("np", F.sum("in_p").over(w)).withColumn("ns", F.sum("in_s").over(w))
    union = F.col("n").between(*union_range) if union_range else (F.lit(union_multi) | (F.col("n") <= 1))
    guarded = (F.col("ns") > 0) & (F.col("np") / F.col("ns") >= max_ratio) if max_ratio is not None else F.lit(False)
    outside = ~union if outside_primary and union_range else F.lit(False)
    keep = F.when(union & ~guarded, F.lit(True)).when(outside, F.col("in_p") == 1).otherwise(F.col("in_s") == 1)
    return structure.first_seen(per.filter(keep), ["_o"])


def fuse_by_vote(patients: DataFrame, sources: Sequence[DataFrame], min_votes: int = 2, single_sources: Sequence[int] | None = None, single_min_votes: int | None = None) -> DataFrame:
    """Values of at least ``min_votes`` sources per patient; articles with one patient may use a subset of the sources (numbers from 0) and another threshold."""
    if not sources:
        raise ValueError("at least one association source is required")
    if not 1 <= min_votes <= len(sources):
        raise ValueError("min_votes must be between 1 and the number of sources")
    need = single_min_votes if single_min_votes is not None else min_votes
    if single_sources is not None:
        if not single_sources or any(not 0 <= i < len(sources) for i in single_sources):
            raise ValueError("single-patient source index is out of range")
        if len(set(single_sources)) != len(single_sources):
            raise ValueError("single-patient source indices must be unique")
        if not 1 <= need <= len(single_sources):
            raise ValueError("single-patient min votes must be between 1 and its source count")
    frame = patients.select("pmc_id", "patient_id", F.count("*").over(Window.partitionBy("pmc_id")).alias("n")).distinct()
    rows = _tagged(sources).join(frame, ["pmc_id", "patient_id"])
    place = F.col("source")
    required = F.lit(min_votes)
    if single_sources is not None:
        place = F.when(F.col("n") == 1, F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(single_sources)])).otherwise(place)
        required = F.when(F.col("n") == 1, need).otherwise(min_votes)
    per = rows.withColumn("place", place).filter("place is not null").groupBy(*_VALUE, "n").agg(F.countDistinct("source").alias("votes"), F.min(F.struct("place", "ord")).alias("_o"))
    return structure.first_seen(per.filter(F.col("votes") >= required), ["_o"])


def augment(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Values of ``extra`` appended to each patient that ``base`` lists; patients without base values count as listed if ``base`` says so by a null value."""
    listed = base.select("pmc_id", "patient_id").distinct()
    rows = _tagged([base.filter("value is not null"), extra.join(listed, ["pmc_id", "patient_id"], "left_semi")])
    return structure.first_seen(rows, ["source", "ord"])


def eligible_additions(additions: DataFrame, passages: DataFrame, sections: set[str], reject_negated: bool = True, reject_nested: bool = True) -> DataFrame:
    """Additions within a passage of the sections, not inside a longer addition, and without a negator shortly before in their sentence."""
    rows = es.locate(additions, passages).filter(F.upper(F.coalesce("section", F.lit(""))).isin(*{s.upper() for s in sections}) & F.col("p_idx").isNotNull())
    if reject_nested:
        inner = es.nested(additions).select("pmc_id", "e_ord")
        rows = rows.join(inner, ["pmc_id", "e_ord"], "left_anti")
    if reject_negated:
        start = F.col("offset") - F.col("p_off")
        sentence = tx.sentence_start(F.col("p_text"), start)
        rows = rows.filter(~tx.slice_text(F.col("p_text"), F.greatest(sentence, start - 80), start).rlike(tx.NEGATION_NEAR))
    return rows.select(*additions.columns)


def _supported(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose value is allowed as a whole or by all of its single ids."""
    sets = allowed.groupBy("pmc_id").agg(F.collect_set("value").alias("_allowed"))
    units = tx.units(F.col("value"))
    ok = F.array_contains("_allowed", F.col("value")) | ((F.size(units) > 0) & (F.size(F.array_except(units, F.col("_allowed"))) == 0))
    return rows.join(sets, "pmc_id").filter(ok).drop("_allowed")


def stabilize(patients: DataFrame, passages: DataFrame, anchors: DataFrame, base: DataFrame, entities: DataFrame, additions: DataFrame, addition_associations: DataFrame, sections: set[str] | None = None, reject_negated: bool = True, reject_nested: bool = True, new_values_only: bool = True, final_structure_filter: bool = False, previous_distance: int = 4000, next_distance: int = 300, preserve_groups: bool = False) -> DataFrame:
    """Base values that the final mentions still support, then decisions on eligible additions; optionally clipped by structure, with group statements restored."""
    frame = patients.select("pmc_id", "patient_id").distinct()
    old = _supported(base, entity_values(entities, whole=False))
    fresh = entity_values(eligible_additions(additions, passages, sections or {"CASE", "METHODS", "RESULTS"}, reject_negated, reject_nested), whole=False)
    if new_values_only:
        fresh = fresh.join(base.select("pmc_id", "value").distinct(), ["pmc_id", "value"], "left_anti")
    extra = _supported(addition_associations, fresh)
    rows = structure.first_seen(_tagged([old, extra]).join(frame, ["pmc_id", "patient_id"], "left_semi"), ["source", "ord"])
    if not final_structure_filter:
        return rows
    clipped = structure.filter_by_structure(rows, entities, passages, anchors, patients, previous_distance=previous_distance, next_distance=next_distance)
    if not preserve_groups:
        return clipped
    grouped = structure.propagate_groups(clipped, entities, passages, anchors, patients)
    return grouped.join(rows.select(*_VALUE), _VALUE, "left_semi").select(*clipped.columns)
