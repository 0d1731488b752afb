"""Set operations, votes and gates on mention tables (pmc_id, e_ord, identifier, type, offset, length, text, note).

The key of a mention is (pmc_id, offset, length, identifier, note), compared null-safe. All operators shuffle on pmc_id or
the key; results carry ``e_ord`` in the order offset, longest first, identifier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["pmc_id", "offset", "length", "identifier", "note"]
_FIELDS = ["pmc_id", "identifier", "type", "offset", "length", "text", "note"]


def same_key(a: str, b: str, note: bool = True) -> Column:
    keys = KEY if note else KEY[:-1]
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) if k == "note" else F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys])


def ordered(rows: DataFrame) -> DataFrame:
    """``e_ord`` in the order offset, longest first, identifier, note."""
    w = Window.partitionBy("pmc_id").orderBy("offset", F.desc("length"), "identifier", F.col("note").asc_nulls_first())
    return rows.withColumn("e_ord", F.row_number().over(w) - 1)


def require_partners(base: DataFrame, other: DataFrame, what: str) -> None:
    """Every article of ``base`` needs a row in ``other``: the first missing one is named in the error."""
    missing = base.select("pmc_id").join(other.select("pmc_id"), "pmc_id", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"missing {what} for PMC {missing[0][0]}")


def merge(*collections: DataFrame) -> DataFrame:
    """Union of mentions; of equal keys the last collection's last row is kept."""
    tagged = [c.select(*_FIELDS, F.lit(i).alias("_c"), F.col("e_ord").alias("_p")) for i, c in enumerate(collections)]
    rows = reduce(DataFrame.unionByName, tagged)
    last = rows.groupBy(*KEY).agg(F.max(F.struct("_c", "_p", "type", "text")).alias("_r"))
    return ordered(last.select("pmc_id", "identifier", "_r.type", "offset", "length", "_r.text", "note"))


def subtract(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate mentions whose key is not among those of ``base``."""
    left = candidates.alias("c").join(base.select(*KEY).alias("b"), same_key("c", "b"), "left_anti")
    return merge(left)


def select_by_vote(sources: DataFrame, n_sources: int, min_votes: int = 2, max_text_length: int | None = None) -> DataFrame:
    """Mentions of at least ``min_votes`` of the sources (a ``source`` number column); the first source's first row stands for the key."""
    if n_sources < 1:
        raise ValueError("at least one entity source is required")
    if not 1 <= min_votes <= n_sources:
        raise ValueError("min_votes must be between 1 and the number of sources")
    if max_text_length is not None and max_text_length < 1:
        raise ValueError("max_text_length must be positive")
    voted = sources.groupBy(*KEY).agg(F.countDistinct("source").alias("votes"), F.min(F.struct("source", "e_ord", "type", "text")).alias("_r")).filter(F.col("votes") >= min_votes)
    if max_text_length is not None:
        voted = voted.filter(F.length(F.coalesce("_r.text", F.lit(""))) <= max_text_length)
    return ordered(voted.select("pmc_id", "identifier", "_r.type", "offset", "length", "_r.text", "note"))


def vote(base: DataFrame, sources: DataFrame, n_sources: int, min_votes: int = 2, max_text_length: int | None = None) -> DataFrame:
    """``base`` and the mentions that reach the vote."""
    return merge(base, select_by_vote(sources, n_sources, min_votes, max_text_length))


def locate(rows: DataFrame, passages: DataFrame, offset: str = "offset", text: bool = True) -> DataFrame:
    """``rows`` with p_idx, section, p_off and, if wanted, p_text of the first passage that holds the offset, else nulls.

    The spans of an article are few and small, so they travel as one array; the text of the one passage is fetched afterwards.
    """
    spans = passages.groupBy("pmc_id").agg(F.array_sort(F.collect_list(F.struct("p_idx", "section", "p_off", "p_end"))).alias("_spans"))
    found = F.filter("_spans", lambda s: (s["p_off"] <= F.col(offset)) & (F.col(offset) < s["p_end"]))
    at = rows.join(spans, "pmc_id", "left").withColumn("_p", F.get(found, F.lit(0))).select(*rows.columns, "_p.p_idx", "_p.section", "_p.p_off")
    if not text:
        return at
    texts = passages.select("pmc_id", "p_idx", F.col("text").alias("p_text"))
    return at.join(texts, ["pmc_id", "p_idx"], "left").select(*rows.columns, "p_idx", "section", "p_off", "p_text")


def nested(rows: DataFrame) -> DataFrame:
    """Mentions that lie strictly inside a longer one of the same article."""
    end = lambda a: F.col(f"{a}.offset") + F.col(f"{a}.length")
    inside = (F.col("a.pmc_id") == F.col("o.pmc_id")) & (F.col("o.offset") <= F.col("a.offset")) & (end("a") <= end("o")) & (F.col("o.length") > F.col("a.length"))
    return rows.alias("a").join(rows.select("pmc_id", "offset", "length").distinct().alias("o"), inside, "left_semi")


def not_overlapping(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Rows whose span shares no code point with a span of ``base``."""
    hit = (F.col("c.pmc_id") == F.col("b.pmc_id")) & (F.greatest(F.col("c.offset"), F.col("b.offset")) < F.least(F.col("c.offset") + F.col("c.length"), F.col("b.offset") + F.col("b.length")))
    return rows.alias("c").join(base.select("pmc_id", "offset", "length").distinct().alias("b"), hit, "left_anti")


def judge_gate(candidates: DataFrame, passages: DataFrame, additions: DataFrame, judged: DataFrame, sections: set[str] | None = None, min_text_length: int = 0) -> DataFrame:
    """Drops the gated mentions that the judge has not accepted; gated are additions of the sections and text length, no sections meaning all."""
    if min_text_length < 0:
        raise ValueError("minimum entity text length must be non-negative")
    flag = lambda df, name: df.select(*KEY).distinct().withColumn(name, F.lit(True))
    rows = locate(candidates, passages, text=False).alias("c")
    rows = rows.join(flag(additions, "added").alias("a"), same_key("c", "a"), "left").select("c.*", "a.added").alias("c")
    rows = rows.join(flag(judged, "accepted").alias("j"), same_key("c", "j"), "left").select("c.*", "j.accepted")
    gated = F.coalesce("added", F.lit(False)) & (F.length(F.coalesce("text", F.lit(""))) >= min_text_length)
    if sections:
        gated &= F.upper(F.coalesce("section", F.lit(""))).isin(*{s.upper() for s in sections})
    return rows.filter(~gated | F.coalesce("accepted", F.lit(False))).select("pmc_id", "e_ord", *_FIELDS[1:])
