"""Batches, size-bounded chunks and calibration examples for calls to a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed_batches(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """``rows`` with ``batch`` and ``index`` within it: consecutive rows of a group, ``size`` to a batch."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return rows.withColumn("_n", n).withColumn("batch", F.floor(F.col("_n") / size).cast("int")).withColumn("index", (F.col("_n") % size).cast("int")).drop("_n")


def greedy_chunks(rows: DataFrame, group: str, order: str, size: Column, most: int) -> DataFrame:
    """(group, order, chunk): a chunk is closed when the next row would make it larger than ``most``; a row larger than that stands alone."""
    packed = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), size.cast("bigint").alias("s")))).alias("items"))
    start = F.struct(F.lit(-1).alias("chunk"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        new = (acc["chunk"] < 0) | (acc["used"] + x["s"] > most)
        chunk = F.when(new, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(new, x["s"]).otherwise(acc["used"] + x["s"]).alias("used"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    chunks = packed.withColumn("chunks", F.aggregate("items", start, step, lambda acc: acc["out"]))
    return chunks.select(group, F.explode(F.arrays_zip("items", "chunks")).alias("z")).select(group, F.col("z.items.o").alias(order), F.col("z.chunks").alias("chunk"))


def tie_break(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def calibration_examples(batch_rows: DataFrame, examples: DataFrame, per_label: int) -> DataFrame:
    """(pmc_id, batch, accepted, rank_no, tie): for each batch the best examples of either label.

    Rank: a shared surface, a shared single id, a shared section, then the greatest tie value. Only the ``per_label`` best of
    each (surface, identifier, section) can win anything, and of those without shared surface or id only the best of a
    section or of all; so batches meet examples through equal values, never all with all.
    """
    top = lambda df, *by: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "accepted").orderBy(F.desc("tie")))).filter(F.col("_r") <= per_label).drop("_r")
    pool = top(examples, "surface", "identifier", "section")
    key = ["pmc_id", "batch"]
    surfaces = batch_rows.select(*key, "surface").distinct().withColumn("s", F.lit(1))
    ids = batch_rows.select(*key, F.explode(F.split("identifier", ";")).alias("unit")).distinct().withColumn("i", F.lit(1))
    sections = batch_rows.select(*key, "section").distinct().withColumn("c", F.lit(1))
    batches = batch_rows.select(*key).distinct()
    units = pool.withColumn("unit", F.explode(F.split("identifier", ";")))
    best = top(pool).withColumn("k", F.lit(1))
    cols = [*key, "surface", "identifier", "section", "accepted", "tie"]
    met = [
        surfaces.join(pool, "surface").select(*cols),
        ids.join(units, "unit").select(*cols),
        sections.join(top(pool, "section"), "section").select(*cols),
        batches.withColumn("k", F.lit(1)).join(F.broadcast(best), "k").select(*cols),  # at most two times per_label rows
    ]
    pairs = reduce(DataFrame.unionByName, met).distinct()
    hit = pairs.join(surfaces, [*key, "surface"], "left").join(sections, [*key, "section"], "left")
    shared = pairs.withColumn("unit", F.explode(F.split("identifier", ";"))).join(ids, [*key, "unit"], "left_semi").select(*key, "identifier").distinct().withColumn("i", F.lit(1))
    hit = hit.join(shared, [*key, "identifier"], "left")
    order = [F.desc(F.coalesce(c, F.lit(0))) for c in ("s", "i", "c")]
    ranked = hit.withColumn("rank_no", F.row_number().over(Window.partitionBy(*key, "accepted").orderBy(*order, F.desc("tie"))))
    return ranked.filter(F.col("rank_no") <= per_label).select(*key, "accepted", "rank_no", "tie")
