"""The N highest-scoring items of every group, by salted ranking in two stages.

Each group is hashed into subgroups by identifier; the first N of each subgroup are ranked and kept (Spark prunes to N per
subgroup before the shuffle as well), then the survivors of a group, at most N times the number of subgroups, are ranked
again. A group that holds a third of all rows is thereby sorted in as many tasks as there are subgroups.

Defined cases: an identifier that comes several times counts once, with its best row by the tie rule; null or NaN scores
and null group keys other than those named in ``nullable`` take no part; ties go by the order columns, then the identifier;
null order columns come last. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUBGROUPS = 32


def top_items(rows: DataFrame, group: Sequence[str], identifier: str, score: str, order: Sequence[str] = (), n: int = 3, subgroups: int = SUBGROUPS, nullable: Sequence[str] = ()) -> DataFrame:
    """(group columns, identifier, rank_no): the first ``n`` of each group by score descending, ``order`` ascending, identifier."""
    valid = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(identifier).isNotNull()
    for g in group:
        if g not in nullable:
            valid &= F.col(g).isNotNull()
    by = [F.col(score).desc(), *(F.col(o).asc_nulls_last() for o in order), F.col(identifier).asc()]
    sub = F.pmod(F.xxhash64(identifier), F.lit(subgroups)).cast("int")
    part = rows.filter(valid).select(*group, identifier, score, *order).withColumn("_sub", sub)
    # repeated deliveries of an item tie and share a dense rank, so they cannot push others out
    first = part.withColumn("_r", F.dense_rank().over(Window.partitionBy(*group, "_sub").orderBy(*by))).filter(F.col("_r") <= n)
    once = first.withColumn("_c", F.row_number().over(Window.partitionBy(*group, "_sub", identifier).orderBy("_r"))).filter("_c = 1")
    best = once.withColumn("rank_no", F.row_number().over(Window.partitionBy(*group).orderBy(*by)))
    return best.filter(F.col("rank_no") <= n).select(*group, identifier, F.col("rank_no").cast("int").alias("rank_no"))
