"""Acronyms that an article defines beside a finding, and their other occurrences as candidates."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionloom.functions import text as tx
from mentionloom.operators import entity_sets as es

# What an acronym is, and how it stands in brackets after its long form or before it.
ACRONYM = r"[A-Z][A-Z0-9]*(?:[-/][A-Z0-9]+)*"
AFTER_LONG_FORM = rf"^\s*\(\s*({ACRONYM})\s*\)"
BEFORE_LONG_FORM = rf"({ACRONYM})\s*\(\s*$"
_FIND = regex.compile(rf"(?<![A-Za-z0-9]){ACRONYM}(?![A-Za-z0-9])")


def definitions(entities: DataFrame, passages: DataFrame) -> DataFrame:
    """(pmc_id, acronym, identifier): acronyms in brackets after a finding, or before a finding in brackets, with its initials; only those with one identifier."""
    e = es.locate(entities.filter(tx.is_positive(F.col("note")) & (F.col("identifier") != "-1") & F.col("text").isNotNull()), passages).filter("p_idx is not null")
    start = F.col("offset") - F.col("p_off")
    end = start + F.col("length")
    text = F.col("p_text")
    e = e.filter(end <= F.length(text))
    after = F.regexp_extract(tx.slice_text(text, end, end + 24), AFTER_LONG_FORM, 1)
    closes = tx.slice_text(text, end, end + 4).rlike(r"^\s*\)")
    before = F.when(closes, F.regexp_extract(tx.slice_text(text, F.greatest(start - 24, F.lit(0)), start), BEFORE_LONG_FORM, 1))
    found = e.withColumn("acronym", F.explode(F.array_compact(F.array(after, before))))
    compact = F.regexp_replace("acronym", "[^A-Z0-9]", "")
    fits = found.filter((F.length(compact) >= 2) & (compact == tx.initials(F.col("text"))))
    return fits.groupBy("pmc_id", "acronym").agg(F.countDistinct("identifier").alias("n"), F.min("identifier").alias("identifier")).filter("n = 1").select("pmc_id", "acronym", "identifier")


def acronyms(passages: DataFrame) -> DataFrame:
    """(pmc_id, p_idx, start, acronym): every free-standing acronym, in code points."""

    def run(batches):
        for batch in batches:
            rows = [(a, i, m.start(), m[0]) for a, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for m in _FIND.finditer(t)]
            a, i, s, x = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(i, pa.int32()), pa.array(s, pa.int32()), pa.array(x, pa.string())], names=["pmc_id", "p_idx", "start", "acronym"])

    return passages.select("pmc_id", "p_idx", "text").mapInArrow(run, "pmc_id string, p_idx int, start int, acronym string")


def abbreviation_candidates(entities: DataFrame, passages: DataFrame) -> DataFrame:
    """Mentions of defined acronyms that no mention of the same span and identifier covers yet."""
    at = acronyms(passages).join(definitions(entities, passages), ["pmc_id", "acronym"]).join(passages.select("pmc_id", "p_idx", "p_off"), ["pmc_id", "p_idx"])
    rows = at.select("pmc_id", "identifier", F.lit("Phenotype").alias("type"), (F.col("p_off") + F.col("start")).alias("offset"), F.length("acronym").alias("length"), F.col("acronym").alias("text"), F.lit(None).cast("string").alias("note"))
    new = rows.join(entities.select("pmc_id", "offset", "length", "identifier"), ["pmc_id", "offset", "length", "identifier"], "left_anti")
    return es.ordered(new.dropDuplicates(es.KEY))
