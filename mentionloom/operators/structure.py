"""Findings and patients by place in the article: nearest patient, local structure, explicit groups.

Inputs are the long tables of ``sources.articles``. Findings and patient mentions of an article are merged by offset and
passed over once in either direction; what they share a passage with comes as the few mentions of that passage. No finding
meets all patients of its article.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.functions import text as tx
from mentionloom.operators.entity_sets import locate

FAR = 10**12
# Mentions that name no particular patient, and wording that speaks of all patients at once.
GENERIC_MENTIONS = ("case", "individual", "man", "patient", "person", "proband", "subject", "woman")
GROUP_CUE = r"(?i)\b(?:all|both|patients?|individuals?|siblings?|sibs?)\b"
ALL_PATIENTS = r"(?i)\b(?:both\s+(?:of\s+)?(?:our\s+)?patients|one\s+patient\b[^.!?;]{0,100}\bthe\s+other|both\s+associated\s+with\b|one\s+patient\b[^.!?;]{0,100}\b(?:suspected|confirmed)\s+in\s+the\s+other)\b"
GROUP_PRONOUN = r"(?i)^\s*(?:all|both|they|their)\b"
ALL_BUT = r"(?i)\ball\s+but\s+(?:individual|patient)?\s*([A-Za-z0-9:.-]+)"
ONLY_AFTER_NAME = r"[^.!?;]{0,35}\b(?:additionally|only|alone)\b"
DESCRIBING = r"(?i)\b(?:presented|characterized|features?)\b"


def whole_value(identifier: Column, text: Column) -> Column:
    return F.when(identifier == "-1", F.coalesce(text, F.lit(""))).otherwise(identifier)


def single_values(identifier: Column, text: Column) -> Column:
    return F.when(identifier == "-1", F.array(F.coalesce(text, F.lit("")))).otherwise(F.split(identifier, ";"))


def first_seen(rows: DataFrame, order: list[str]) -> DataFrame:
    """Distinct (pmc_id, patient_id, value) with ``v_ord`` from 0 in the order of first appearance."""
    first = rows.groupBy("pmc_id", "patient_id", "value").agg(F.min(F.struct(*order)).alias("_o"))
    w = Window.partitionBy("pmc_id", "patient_id").orderBy("_o", "value")
    return first.select("pmc_id", "patient_id", (F.row_number().over(w) - 1).alias("v_ord"), "value")


def placed(entities: DataFrame, passages: DataFrame) -> DataFrame:
    """Positive mentions within a passage, with the bounds of their sentence in article offsets."""
    at = locate(entities.filter(tx.is_positive(F.col("note"))), passages).filter("p_idx is not null")
    start = F.col("offset") - F.col("p_off")
    return at.withColumn("s_start", F.col("p_off") + tx.sentence_start(F.col("p_text"), start)).withColumn("s_end", F.col("p_off") + tx.sentence_end(F.col("p_text"), start + F.col("length")))


def _neighbours(e: DataFrame, anchors: DataFrame, before: list[Column], after: list[Column]) -> DataFrame:
    """(pmc_id, e_ord, prev, next): the last patient mention at or before each finding and the first one after it, as (m_off, patient_id); of mentions at one offset the last in the order of ``before`` or ``after`` holds."""
    kinds = {"e_ord": "bigint", "patient_id": "string", "patient_ord": "int", "m_ord": "int"}
    fill = lambda df, **has: df.select("pmc_id", *[has[c].cast(t).alias(c) if c in has else F.lit(None).cast(t).alias(c) for c, t in {**kinds, "pos": "bigint", "kind": "int"}.items()])
    merged = fill(e, e_ord=F.col("e_ord"), pos=F.col("offset"), kind=F.lit(1)).unionByName(fill(anchors, patient_id=F.col("patient_id"), patient_ord=F.col("patient_ord"), m_ord=F.col("m_ord"), pos=F.col("m_off"), kind=F.lit(0)))
    at = F.when(F.col("kind") == 0, F.struct(F.col("pos").alias("m_off"), "patient_id"))
    on = Window.partitionBy("pmc_id").orderBy("pos", "kind", *before).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("pmc_id").orderBy(F.desc("pos"), F.desc("kind"), *after).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = merged.withColumn("prev", F.last(at, ignorenulls=True).over(on)).withColumn("next", F.last(at, ignorenulls=True).over(back))
    return near.filter("kind = 1").select("pmc_id", F.col("e_ord").alias("e_ord"), "prev", "next")


def _in_passages(anchors: DataFrame, passages: DataFrame) -> DataFrame:
    """(pmc_id, p_idx, named): the patient mentions of each passage, as (m_off, patient_id)."""
    a = locate(anchors, passages, "m_off", text=False).filter("p_idx is not null")
    return a.groupBy("pmc_id", "p_idx").agg(F.collect_list(F.struct(F.col("m_off").cast("bigint").alias("m_off"), "patient_id")).alias("named"))


def structural_patients(entities: DataFrame, passages: DataFrame, anchors: DataFrame, previous_distance: int = 3000, next_distance: int = 300, wide_sections: set[str] | None = None, wide_previous_distance: int | None = None, wide_next_distance: int | None = None) -> DataFrame:
    """(pmc_id, e_ord, patient_id): patients named in the mention's sentence, else in its passage, else the nearest before and after within the distances."""
    e = placed(entities, passages).select("pmc_id", "e_ord", "offset", "p_idx", "s_start", "s_end", F.upper(F.coalesce("section", F.lit(""))).alias("section"))
    order = ("patient_ord", "m_ord", "patient_id")
    wide = F.col("section").isin(*wide_sections) if wide_sections else F.lit(False)
    before = F.when(wide, wide_previous_distance if wide_previous_distance is not None else previous_distance).otherwise(previous_distance)
    after = F.when(wide, wide_next_distance if wide_next_distance is not None else next_distance).otherwise(next_distance)
    per = e.join(_in_passages(anchors, passages), ["pmc_id", "p_idx"], "left").join(_neighbours(e, anchors, [F.col(c) for c in order], [F.desc(c) for c in order]), ["pmc_id", "e_ord"])
    ids = lambda named: F.array_distinct(F.transform(named, lambda x: x["patient_id"]))
    here = F.coalesce("named", F.array().cast("array<struct<m_off:bigint,patient_id:string>>"))
    sentence = ids(F.filter(here, lambda x: (F.col("s_start") <= x["m_off"]) & (x["m_off"] < F.col("s_end"))))
    near = F.array_compact(F.array(F.when(F.col("offset") - F.col("prev.m_off") <= before, F.col("prev.patient_id")), F.when(F.col("next.m_off") - F.col("offset") <= after, F.col("next.patient_id"))))
    chosen = F.when(F.size(sentence) > 0, sentence).when(F.size(here) > 0, ids(here)).otherwise(F.array_distinct(near))
    return per.select("pmc_id", F.col("e_ord").cast(dict(entities.dtypes)["e_ord"]).alias("e_ord"), F.explode(chosen).alias("patient_id"))


def filter_by_structure(associations: DataFrame, entities: DataFrame, passages: DataFrame, anchors: DataFrame, patients: DataFrame, **distances) -> DataFrame:
    """Of articles with several patients, the values that a mention supports for the patient by structure; all of other articles."""
    support = structural_patients(entities, passages, anchors, **distances).join(entities, ["pmc_id", "e_ord"]).select("pmc_id", "patient_id", F.explode(single_values(F.col("identifier"), F.col("text"))).alias("value")).distinct().withColumn("_ok", F.lit(True))
    many = patients.groupBy("pmc_id").agg(F.count("*").alias("_n"))
    rows = associations.join(many, "pmc_id", "left").join(support, ["pmc_id", "patient_id", "value"], "left")
    return rows.filter((F.coalesce("_n", F.lit(0)) <= 1) | F.col("_ok")).select(*associations.columns)


def by_proximity(entities: DataFrame, passages: DataFrame, anchors: DataFrame, patients: DataFrame, same_passage_distance: int = 3500, global_distance: int = 1200) -> DataFrame:
    """(pmc_id, patient_id, v_ord, value): each positive mention goes to the nearest patient of its passage, or else of the article; ties to the smaller id.

    A mention whose passage names a patient too far away is not given to another passage's patient. The only patient of an
    article takes every mention of passages without patients.
    """
    e = locate(entities.filter(tx.is_positive(F.col("note"))), passages, text=False).filter("p_idx is not null").select("pmc_id", "e_ord", "offset", "p_idx", whole_value(F.col("identifier"), F.col("text")).alias("value"))
    ids = patients.select("pmc_id", "patient_id").distinct().groupBy("pmc_id").agg(F.count("*").alias("_n"), F.min("patient_id").alias("_first"))
    smallest = [F.desc("patient_id")]
    near_id = _neighbours(e, anchors, smallest, smallest)
    per = e.join(ids, "pmc_id").join(_in_passages(anchors, passages), ["pmc_id", "p_idx"], "left").join(near_id, ["pmc_id", "e_ord"])
    gap = lambda x: F.struct(F.abs(F.col("offset") - x["m_off"]).alias("d"), x["patient_id"].alias("p"))
    nearest = F.array_min(F.transform(F.array_compact(F.array("prev", "next")), gap))
    per = per.withColumn("near", F.array_min(F.transform("named", gap))).withColumn("far", F.coalesce(nearest, F.struct(F.lit(FAR).alias("d"), F.col("_first").alias("p"))))
    patient = F.when(F.col("near").isNotNull(), F.when(F.col("near.d") <= same_passage_distance, F.col("near.p"))).otherwise(F.when((F.col("_n") == 1) | (F.col("far.d") <= global_distance), F.col("far.p")))
    return first_seen(per.withColumn("patient_id", patient).filter("patient_id is not null"), ["offset", "e_ord"])


def patient_aliases(anchors: DataFrame, patients: DataFrame) -> DataFrame:
    """(pmc_id, alias, patient_id): lower-case ids, ids without a leading O, and mentions that name somebody; the first patient has an alias."""
    own = patients.select("pmc_id", "patient_ord", "patient_id", F.col("patient_id").alias("alias"))
    short = patients.filter(F.col("patient_id").startswith("O") & (F.length("patient_id") > 1)).select("pmc_id", "patient_ord", "patient_id", F.expr("substring(patient_id, 2)").alias("alias"))
    told = anchors.select("pmc_id", "patient_ord", "patient_id", F.trim(F.regexp_replace(F.coalesce("m_text", F.lit("")), r"(?U)\s+", " ")).alias("alias")).filter((F.length("alias") >= 2) & ~F.lower("alias").isin(*GENERIC_MENTIONS))
    rows = own.unionByName(short).unionByName(told).withColumn("alias", F.lower("alias"))
    return rows.groupBy("pmc_id", "alias").agg(F.min_by("patient_id", "patient_ord").alias("patient_id"))


def _named(alias: str) -> Column:
    return F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), F.col(alias), F.lit(r"\E(?![A-Za-z0-9])"))


def propagate_groups(associations: DataFrame, entities: DataFrame, passages: DataFrame, anchors: DataFrame, patients: DataFrame) -> DataFrame:
    """Adds the values that a sentence states of an explicit group of patients, after each patient's own values.

    A group is two patients named in a sentence with a group word; all of two patients by wording that covers both, or
    "both" with a describing verb in an abstract; or, after a pronoun, those named in the sentence before. Negated findings
    add nothing; "additionally/only/alone" after a name narrows to it; "all but" takes names out.
    """
    count = patients.groupBy("pmc_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    e = placed(entities, passages).join(count, "pmc_id")
    text, off = F.col("p_text"), F.col("p_off")
    prior_end = F.greatest(F.col("s_start") - off - 1, F.lit(0))
    e = e.select(
        "pmc_id", "e_ord", "_n", "identifier", "text", F.upper(F.coalesce("section", F.lit(""))).alias("section"),
        tx.slice_text(text, F.col("s_start") - off, F.col("s_end") - off).alias("sentence"),
        tx.slice_text(text, tx.sentence_start(text, prior_end), F.col("s_start") - off).alias("prior"),
        (F.col("offset") - F.col("s_start")).alias("at"), (F.col("offset") + F.col("length") - F.col("s_start")).alias("until"),
    )
    near = tx.slice_text(F.col("sentence"), F.greatest(F.col("at") - 80, F.lit(0)), F.col("at"))
    e = e.filter(~near.rlike(tx.NEGATION_NEAR)).withColumn("prefix", tx.slice_text(F.col("sentence"), F.lit(0), F.col("at")))
    e = e.withColumn("but", F.regexp_extract(F.substr(F.expr("substring(sentence, until + 1)"), F.lit(1), F.lit(100)), ALL_BUT, 0))
    names = e.join(patient_aliases(anchors, patients), "pmc_id")
    hit = lambda column: F.collect_set(F.when(F.rlike(F.col(column), _named("alias")), F.col("patient_id")))
    only = F.rlike(F.col("prefix"), F.concat(_named("alias"), F.lit(ONLY_AFTER_NAME)))
    keys = ["pmc_id", "e_ord", "_n", "identifier", "text", "section", "sentence"]
    seen = names.groupBy(*keys).agg(hit("sentence").alias("here"), hit("prior").alias("before"), hit("but").alias("out"), F.min(F.when(only, F.struct("alias", "patient_id"))).alias("one"))
    everyone = patients.groupBy("pmc_id").agg(F.collect_set("patient_id").alias("everyone"))
    seen = seen.join(everyone, "pmc_id")
    both = (F.col("_n") == 2) & (F.col("sentence").rlike(ALL_PATIENTS) | ((F.col("section") == "ABSTRACT") & F.col("sentence").rlike(r"(?i)\bboth\b") & F.col("sentence").rlike(DESCRIBING)))
    group = F.when((F.size("here") >= 2) & F.col("sentence").rlike(GROUP_CUE), F.col("here")).when(both, F.col("everyone")).when(F.col("sentence").rlike(GROUP_PRONOUN) & (F.size("before") >= 2), F.col("before"))
    narrowed = F.when(group.isNotNull(), F.array_except(F.coalesce(F.when(F.col("one").isNotNull(), F.array("one.patient_id")), group), F.col("out")))
    stated = seen.withColumn("patient_id", F.explode(narrowed)).select("pmc_id", "patient_id", F.explode(single_values(F.col("identifier"), F.col("text"))).alias("value")).distinct()
    order = entities.filter(tx.is_positive(F.col("note"))).select("pmc_id", "e_ord", F.posexplode(single_values(F.col("identifier"), F.col("text"))).alias("u", "value")).groupBy("pmc_id", "value").agg(F.min(F.struct("e_ord", "u")).alias("_o"))
    w = Window.partitionBy("pmc_id").orderBy("_o")
    ranked = order.select("pmc_id", "value", F.row_number().over(w).alias("o"))
    extra = stated.join(ranked, ["pmc_id", "value"]).select("pmc_id", "patient_id", F.lit(1).alias("part"), F.col("o").alias("ord"), "value")
    own = associations.select("pmc_id", "patient_id", F.lit(0).alias("part"), F.col("v_ord").alias("ord"), "value")
    return first_seen(own.unionByName(extra), ["part", "ord"])
