"""Scores of predictions against gold: mentions, document ids, associations. Ratios of nothing to nothing are 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionloom.functions.text import is_positive


def precision(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp == 0, 1.0).otherwise(tp / (tp + fp))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def with_prf(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = counts.withColumn("precision", precision(tp, fp)).withColumn("recall", precision(tp, fn))
    return rows.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def _both(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    rows = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p")))
    return rows.groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")


def mention_counts(gold: DataFrame, predicted: DataFrame, documents: DataFrame) -> DataFrame:
    """tp, fp, fn over single ids at exact spans; at a gold span without id any prediction is right and none is wrong."""
    pred = predicted.join(documents.select("pmc_id").distinct(), "pmc_id", "left_semi")
    span = ["pmc_id", "offset", "length"]
    positive = lambda df: df.filter(is_positive(F.col("note")) & F.col("identifier").isNotNull())
    units = lambda df: positive(df).filter("identifier <> '-1'").select(*span, F.explode(F.split("identifier", ";")).alias("unit"))
    blank = lambda df: positive(df).filter("identifier = '-1'").select(*span)
    no_id = blank(gold).distinct().withColumn("open", F.lit(1))
    regular = _both(units(gold), units(pred), [*span, "unit"]).join(no_id, span, "left")
    a = regular.agg(_sum((F.col("g") == 1) & (F.col("p") == 1)).alias("tp"), _sum((F.col("g") == 0) & F.col("open").isNull()).alias("fp"), _sum(F.col("p") == 0).alias("fn"))
    any_pred = positive(pred).select(*span)
    spans = _both(blank(gold), any_pred, span).join(blank(pred).distinct().withColumn("blank", F.lit(1)), span, "left")
    b = spans.agg(_sum((F.col("g") == 1) & (F.col("p") == 1)).alias("tp"), _sum((F.col("g") == 0) & F.col("blank").isNotNull()).alias("fp"), _sum((F.col("g") == 1) & (F.col("p") == 0)).alias("fn"))
    return a.unionByName(b).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def document_counts(gold: DataFrame, predicted: DataFrame, documents: DataFrame) -> DataFrame:
    pred = predicted.join(documents.select("pmc_id").distinct(), "pmc_id", "left_semi")
    ids = lambda df: df.filter(is_positive(F.col("note")) & (F.col("identifier") != "-1")).select("pmc_id", F.explode(F.split("identifier", ";")).alias("unit"))
    g, p = F.col("g") == 1, F.col("p") == 1
    return _both(ids(gold), ids(pred), ["pmc_id", "unit"]).agg(_sum(g & p).alias("tp"), _sum(~g & p).alias("fp"), _sum(g & ~p).alias("fn"))


def patient_counts(gold: DataFrame, predicted: DataFrame, gold_patients: DataFrame) -> DataFrame:
    """tp, fp, fn of every gold patient, also of those without values."""
    keys = ["pmc_id", "patient_id"]
    g, p = F.col("g") == 1, F.col("p") == 1
    per = _both(gold, predicted, [*keys, "value"]).groupBy(*keys).agg(_sum(g & p).alias("tp"), _sum(~g & p).alias("fp"), _sum(g & ~p).alias("fn"))
    return gold_patients.select(*keys).distinct().join(per, keys, "left").na.fill(0, ["tp", "fp", "fn"])


def association_scores(per_patient: DataFrame) -> DataFrame:
    """Micro counts and macro averages over the gold patients."""
    rows = with_prf(per_patient)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(1.0))
    return rows.agg(*[_sum(F.col(c)).alias(c) for c in ("tp", "fp", "fn")], mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"), mean("f1").alias("macro_f1"))


def score(mentions: DataFrame, documents: DataFrame, associations: DataFrame) -> DataFrame:
    """One row: the four F1s and their mean."""
    m = with_prf(mentions).select(F.lit(1).alias("k"), F.col("f1").alias("mention_f1"))
    d = with_prf(documents).select(F.lit(1).alias("k"), F.col("f1").alias("document_f1"))
    a = with_prf(associations).select(F.lit(1).alias("k"), F.col("f1").alias("association_micro_f1"), F.col("macro_f1").alias("association_macro_f1"))
    rows = m.join(d, "k").join(a, "k").drop("k")
    return rows.withColumn("score", 0.25 * (F.col("mention_f1") + F.col("document_f1")) + 0.25 * (F.col("association_micro_f1") + F.col("association_macro_f1")))
