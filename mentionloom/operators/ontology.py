"""Ontology terms: descendants, canonical ids, alias tables and their resolution.

Terms are (identifier, name, synonyms, parents, alt_ids, obsolete, replaced_by), one row per identifier; ids are compared as
tidied by ``hierarchy.tidy_id``. Null arrays count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.functions.text import GENERIC_ALIASES, normalize_surface
from mentionloom.operators.hierarchy import tidy_id
from mentionloom.session import cut


def latest(terms: DataFrame) -> DataFrame:
    """The row of each identifier that was loaded last, with null obsolete as false."""
    w = Window.partitionBy("identifier").orderBy(F.desc("loaded_at"), F.desc_nulls_last("name"))
    rows = terms.filter(F.trim("identifier") != "").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return rows.withColumn("obsolete", F.coalesce("obsolete", F.lit(False))).withColumn("replaced_by", tidy_id(F.col("replaced_by")))


def descendants(terms: DataFrame, root: str | DataFrame) -> DataFrame:
    """(identifier): ``root``, one id or a table of them, and everything below it; obsolete terms are passed through. Rounds follow the depth; each round visits new terms only."""
    edges = cut(terms.select("identifier", F.explode("parents").alias("p")).select("identifier", tidy_id(F.col("p")).alias("parent")).filter("parent is not null").distinct())
    fresh = terms.sparkSession.createDataFrame([(root,)], "identifier string") if isinstance(root, str) else root.select("identifier").distinct()
    known = fresh
    while True:
        below = edges.join(fresh.withColumnRenamed("identifier", "parent"), "parent").select("identifier").distinct()
        fresh = cut(below.join(known, "identifier", "left_anti"))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)  # of written tables, one for each level


def canonical(ids: DataFrame, terms: DataFrame, column: str = "identifier") -> DataFrame:
    """``ids`` with ``canonical``: the primary id of an alternative one, then one replacement step if that term is obsolete."""
    primary = terms.select(F.col("identifier").alias("_primary"), F.explode("alt_ids").alias("_alt")).select(tidy_id(F.col("_alt")).alias("_alt"), "_primary").filter("_alt is not null").groupBy("_alt").agg(F.max("_primary").alias("_primary"))
    step = terms.filter("obsolete and replaced_by is not null").select(F.col("identifier").alias("_main"), F.col("replaced_by").alias("_next"))
    rows = ids.join(primary, F.col(column) == F.col("_alt"), "left").withColumn("_main0", F.coalesce("_primary", column))
    rows = rows.join(step, F.col("_main0") == F.col("_main"), "left")
    return rows.withColumn("canonical", F.coalesce("_next", "_main0")).select(*ids.columns, "canonical")


def aliases(terms: DataFrame, normalize: Callable[[Column], Column] = normalize_surface, within: DataFrame | None = None) -> DataFrame:
    """(alias, identifier, preferred): normalised names and synonyms of live terms, of those ``within`` if given."""
    live = terms.filter(~F.col("obsolete"))
    if within is not None:
        live = live.join(within, "identifier", "left_semi")
    named = live.select("identifier", normalize(F.col("name")).alias("alias"), F.lit(1).alias("preferred"))
    other = live.select("identifier", F.explode("synonyms").alias("s")).select("identifier", normalize(F.col("s")).alias("alias"), F.lit(0).alias("preferred"))
    return named.unionByName(other).filter("alias <> ''").groupBy("alias", "identifier").agg(F.max("preferred").alias("preferred"))


def is_long_enough(alias: Column, min_chars: int = 4, min_letters: int = 2) -> Column:
    return (F.length(alias) >= min_chars) & (F.length(F.regexp_replace(alias, r"[^\p{L}]", "")) >= min_letters)


def long_enough(alias_rows: DataFrame, min_chars: int = 4, min_letters: int = 2) -> DataFrame:
    return alias_rows.filter(is_long_enough(F.col("alias"), min_chars, min_letters))


def admissible(alias_rows: DataFrame, min_chars: int = 4, min_letters: int = 2) -> DataFrame:
    return long_enough(alias_rows, min_chars, min_letters).filter(~F.col("alias").isin(*GENERIC_ALIASES))


def external_aliases(pairs: DataFrame, terms: DataFrame, within: DataFrame, normalize: Callable[[Column], Column] = normalize_surface) -> DataFrame:
    """(alias, identifier) of an external dictionary's (alias, identifier) rows: normalised, canonical, and only terms ``within``."""
    named = pairs.select(normalize(F.col("alias")).alias("alias"), "identifier").filter("alias <> '' and identifier is not null")
    known = canonical(named, terms).select("alias", F.col("canonical").alias("identifier"))
    return known.join(within, "identifier", "left_semi").select("alias", "identifier").distinct()


def id_frequency(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """(identifier, freq): mentions of each canonical single id."""
    single = entities.select(F.explode(F.split("identifier", ";")).alias("identifier")).filter(F.col("identifier").startswith("HP:"))
    return canonical(single, terms).groupBy(F.col("canonical").alias("identifier")).agg(F.count("*").alias("freq"))


def resolve(alias_rows: DataFrame, frequency: DataFrame) -> DataFrame:
    """(alias, identifier): of several ids of an alias the most frequent, ties to the greatest id."""
    rows = alias_rows.join(frequency, "identifier", "left")
    return rows.groupBy("alias").agg(F.max_by("identifier", F.struct(F.coalesce("freq", F.lit(0)), "identifier")).alias("identifier"))
