"""Checks of predictions against their input: every violation is a row (code, pmc_id, detail); nothing is raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.operators.entity_sets import KEY, locate
from mentionloom.sources import articles as src


def _violation(wrong: Column, code: str, detail: Column) -> Column:
    return F.when(wrong, F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail")))


def _rows(df: DataFrame, *checks: Column) -> DataFrame:
    """One pass over ``df``: a row for each violation of each of its rows."""
    listed = F.flatten(F.array_compact(F.array(*checks)))
    return df.select("pmc_id", F.explode(listed).alias("v")).select("v.code", "pmc_id", "v.detail")


def validate(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """``predictions`` and ``expected`` are nested rows by ``src.ARTICLE`` fields, with article_row in delivery order."""
    known = expected.select("pmc_id", F.col("pmid").alias("_pmid"), F.transform("patient", lambda p: p["patient_id"]).alias("_patients"))
    w = Window.partitionBy("pmc_id").orderBy("article_row")
    rows = predictions.withColumn("_n", F.row_number().over(w)).join(known.withColumn("_known", F.lit(True)), "pmc_id", "left")
    row, is_known = F.col("article_row"), F.coalesce("_known", F.lit(False))
    given = F.transform("association", lambda a: a["patient_id"])
    one = lambda *checks: F.array_compact(F.array(*checks))
    unlisted = F.transform("association", lambda a, i: _violation(a.isNotNull() & (a["phenotype"].isNull() | F.exists(a["phenotype"], lambda x: x.isNull())), "phenotype_not_a_list", F.concat_ws("/", "article_row", i)))
    documents = _rows(
        rows,
        one(
            _violation(F.col("_n") > 1, "duplicate_document", row),
            _violation(~is_known, "unexpected_document", row),
            _violation(is_known & ~F.col("pmid").eqNullSafe(F.col("_pmid")), "pmid_differs", row),
            _violation(is_known & F.col("entities").isNull(), "entities_not_a_list", row),
            _violation(is_known & F.col("association").isNull(), "association_not_a_list", row),
            _violation(is_known & F.col("association").isNotNull() & ~given.eqNullSafe(F.coalesce("_patients", F.array().cast("array<string>"))), "patients_differ", row),
        ),
        F.when(is_known, F.array_compact(unlisted)),
    )
    entities = rows.filter(is_known).select("pmc_id", "article_row", F.posexplode("entities").alias("e_ord", "e")).select("pmc_id", "article_row", "e_ord", "e.*")
    absent = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("identifier", "length", "offset", "text", "type")]))
    repeat = Window.partitionBy("article_row", F.size("_absent") == 0, *KEY).orderBy("e_ord")
    placed = locate(entities.withColumn("_absent", absent).withColumn("_r", F.row_number().over(repeat)), src.passages(expected))
    named, whole, inside = F.concat_ws("/", "article_row", "e_ord"), F.size("_absent") == 0, F.col("p_idx").isNotNull()
    actual = F.substr("p_text", F.col("offset") - F.col("p_off") + 1, F.greatest(F.col("length"), F.lit(0)))
    mentions = _rows(
        placed,
        one(
            _violation(~whole, "missing_fields", F.concat(named, F.lit(" "), F.array_join("_absent", ","))),
            _violation(whole & (F.col("type") != "Phenotype"), "bad_type", named),
            _violation(whole & ~inside, "outside_passages", named),
            _violation(whole & inside & (actual != F.col("text")), "text_mismatch", named),
            _violation(whole & (F.col("_r") > 1), "duplicate_entity", named),
        ),
    )
    missing = expected.join(predictions, "pmc_id", "left_anti").select(F.lit("missing_document").alias("code"), "pmc_id", F.lit("").alias("detail"))
    counts = predictions.agg(F.count("*").alias("p")).withColumn("k", F.lit(1)).join(expected.agg(F.count("*").alias("e")).withColumn("k", F.lit(1)), "k").filter("p <> e")
    differs = counts.select(F.lit("count_mismatch").alias("code"), F.lit("").alias("pmc_id"), F.concat_ws("/", "p", "e").alias("detail"))
    return documents.unionByName(mentions).unionByName(missing).unionByName(differs)
