import random

from mentionloom.llm.topn import top_items

SCHEMA = "candidate_id bigint, pmc_id string, identifier string, score double, offset int, rank_no string"


def top(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r["candidate_id"], r["rank_no"]) for r in top_items(df, ["pmc_id", "identifier"], "candidate_id", "score", ["offset"], nullable=["pmc_id"], **more).collect()}


def test_ties_nulls_and_repeats(spark):
    rows = [
        (1, "A", "x", 0.5, 9, None), (1, "A", "x", 0.5, 9, None), (2, "A", "x", 0.5, 3, None), (3, "A", "x", 0.9, 1, None), (3, "A", "x", 0.9, 1, None), (4, "A", "x", 0.5, 3, None), (5, "A", "x", float("nan"), 0, None),
        (6, "A", "x", None, 0, None), (7, "A", None, 0.9, 0, None), (8, None, "x", 0.1, None, None), (9, None, "x", 0.1, 4, None), (10, "A", "y", 0.0, 0, "clash"),
    ]
    assert top(spark, rows) == {(3, 1), (2, 2), (4, 3), (9, 1), (8, 2), (10, 1)}


def test_hot_group_against_sorting(spark):
    r = random.Random(5)
    rows = [(i, "H" if i % 3 else f"g{i % 7}", "x", r.choice([0.1, 0.2, 0.3]), r.randint(0, 5), None) for i in range(2000)]
    rows += rows[:300]
    groups = {}
    for i, g, _, s, o, _ in set(rows):
        groups.setdefault(g, []).append((-s, o, i))
    expected = {(i, n + 1) for v in groups.values() for n, (_, _, i) in enumerate(sorted(v)[:3])}
    assert top(spark, rows) == expected == top(spark, rows, subgroups=1)


def test_empty(spark):
    assert top(spark, []) == set()
