"""Nested articles to long tables, and back.

Of several rows of one ``pmc_id`` the last holds (by ``article_row``); rows without an id are left out. Positions count
from 0 in the array as delivered; null elements keep their position and give no row. Null arrays count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_articles(articles: DataFrame, order: str = "article_row") -> DataFrame:
    """The last row of each article. The number of partitions is given, so that what works on texts afterwards is not left with the few that their bytes would fill."""
    w = Window.partitionBy("pmc_id").orderBy(F.col(order).desc())
    parts = int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return articles.filter("pmc_id is not null").repartition(parts, "pmc_id").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def passages(docs: DataFrame) -> DataFrame:
    """(pmc_id, p_idx, section, p_off, p_end, text)"""
    p = docs.select("pmc_id", F.posexplode("full_text").alias("p_idx", "p")).filter("p.text is not null and p.offset is not null")
    return p.select("pmc_id", "p_idx", F.col("p.section_type").alias("section"), F.col("p.offset").alias("p_off"), (F.col("p.offset") + F.length("p.text")).alias("p_end"), F.col("p.text").alias("text"))


def patients(docs: DataFrame) -> DataFrame:
    """(pmc_id, patient_ord, patient_id)"""
    return docs.select("pmc_id", F.posexplode("patient").alias("patient_ord", "p")).filter("p.patient_id is not null").select("pmc_id", "patient_ord", F.col("p.patient_id").alias("patient_id"))


def anchors(docs: DataFrame) -> DataFrame:
    """(pmc_id, patient_ord, m_ord, patient_id, m_off, m_len, m_text): the mentions of the patients"""
    p = docs.select("pmc_id", F.posexplode("patient").alias("patient_ord", "p")).filter("p.patient_id is not null")
    m = p.select("pmc_id", "patient_ord", F.col("p.patient_id").alias("patient_id"), F.posexplode("p.mention").alias("m_ord", "m")).filter("m.offset is not null")
    return m.select("pmc_id", "patient_ord", "m_ord", "patient_id", F.col("m.offset").alias("m_off"), F.col("m.length").alias("m_len"), F.col("m.text").alias("m_text"))


def entities(docs: DataFrame) -> DataFrame:
    """(pmc_id, e_ord, identifier, type, offset, length, text, note)"""
    e = docs.select("pmc_id", F.posexplode("entities").alias("e_ord", "e")).filter("e is not null")
    return e.select("pmc_id", "e_ord", "e.identifier", "e.type", "e.offset", "e.length", "e.text", "e.note")


def associations(docs: DataFrame) -> DataFrame:
    """(pmc_id, patient_ord, patient_id, v_ord, value)"""
    a = docs.select("pmc_id", F.posexplode("association").alias("patient_ord", "a")).filter("a.patient_id is not null")
    return a.select("pmc_id", "patient_ord", F.col("a.patient_id").alias("patient_id"), F.posexplode("a.phenotype").alias("v_ord", "value")).filter("value is not null")


def nest_associations(values: DataFrame, listed: DataFrame) -> DataFrame:
    """One row per article with its associations in patient order; patients without values keep an empty list."""
    per = values.groupBy("pmc_id", "patient_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("v_ord", "value"))), lambda x: x["value"]).alias("phenotype"))
    full = listed.join(per, ["pmc_id", "patient_id"], "left").select("pmc_id", "patient_ord", F.struct("patient_id", F.coalesce("phenotype", F.array().cast("array<string>")).alias("phenotype")).alias("a"))
    return full.groupBy("pmc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("patient_ord", "a"))), lambda x: x["a"]).alias("association"))


def nest_entities(rows: DataFrame) -> DataFrame:
    """One row per article with its entities in order of ``e_ord``."""
    e = F.struct("identifier", "type", "offset", "length", "text", "note")
    return rows.groupBy("pmc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("e_ord", e.alias("e")))), lambda x: x["e"]).alias("entities"))
