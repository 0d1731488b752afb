import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from mentionloom.operators import hierarchy as module
from mentionloom.operators.hierarchy import hierarchy, live_edges, term_hierarchy


def brute(parents):
    below = defaultdict(set)
    for k, ps in parents.items():
        for p in ps:
            below[p].add(k)
    best = {r: (0, r + ">") for r in parents if not parents[r]}
    level = dict(best)
    while level:
        new = {}
        for k, (d, path) in level.items():
            for c in below[k] - best.keys():
                new[c] = min(new.get(c, (d + 1, "~")), (d + 1, f"{path}{c}>"))
        best.update(new)
        level = new
    out = {}
    for k in parents:
        seen, todo = set(), list(below[k])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(below[x])
        d, path = best.get(k, (-1, ">"))
        out[k] = (path[:-1].split(">")[0], d, path[:-1], len(seen - {k}), int(k in seen))
    return out


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 30, 7), (2, 150, 40), (3, 150, 1000)])
def test_random_graphs(spark, seed, n, block):
    r = random.Random(seed)
    ids = [f"T{i:04d}" for i in range(n)]
    graph = {}
    for i, k in enumerate(ids):
        x = r.random()
        graph[k] = [] if x < 0.05 else sorted({ids[max(0, i - r.randint(1, 9))] if r.random() < 0.93 else r.choice(ids) for _ in range(1 + (x > 0.88))})
    df = spark.createDataFrame(list(graph.items()), "identifier string, parents array<string>")
    true = brute(graph)
    for solve in (1000, 40, 1):  # in one block; after several levels; not at all
        assert {x[0]: tuple(x)[1:] for x in hierarchy(df, block, solve).collect()} == true


def test_long_chain_across_blocks(spark):
    n = 60
    df = spark.createDataFrame([(f"N{i:03d}", [f"N{i - 1:03d}"] if i else []) for i in range(n)], "identifier string, parents array<string>")
    got = {r["identifier"]: r for r in hierarchy(df, 9, 10).collect()}
    assert got["N059"]["depth"] == 59 and got["N000"]["n_descendants"] == 59 and got["N059"]["path"].startswith("N000>N001>")


def terms(spark, rows):
    t0 = datetime(2025, 1, 1)
    full = [(i, p, o, r, t0 + timedelta(days=d), "x") for i, p, o, r, d in rows]
    return spark.createDataFrame(full, "identifier string, parents array<string>, obsolete boolean, replaced_by string, loaded_at timestamp, path string")


def test_untidy_terms(spark):
    rows = [
        ("HP:1", None, None, None, 0), ("HP:2", ["hp_1 ! root", None, ""], False, None, 0), ("HP:2", ["HP:9"], False, None, 5), ("HP:3", ["\xa0HP:4"], None, None, 0), ("HP:4", [], True, "HP_5 ", 0),
        ("HP:5", [], True, "HP:2 ! two", 0), ("HP:6", ["HP:7"], None, None, 0), ("HP:7", [], True, "HP:8", 0), ("HP:8", [], True, "HP:7", 0), ("HP:9", ["HP:1", "HP:1", "HP:404"], None, None, 0),
        ("HP:10", ["HP:10"], None, None, 0), ("HP:11", ["HP:10"], None, None, 0), (None, ["HP:1"], None, None, 0), (" ", ["HP:1"], None, None, 0),
    ]
    got = {r["identifier"]: tuple(r)[1:] for r in term_hierarchy(terms(spark, rows)).collect()}
    assert got == {
        "HP:1": ("HP:1", 0, "HP:1", 3, 0), "HP:9": ("HP:1", 1, "HP:1>HP:9", 2, 0), "HP:2": ("HP:1", 2, "HP:1>HP:9>HP:2", 1, 0), "HP:3": ("HP:1", 3, "HP:1>HP:9>HP:2>HP:3", 0, 0),
        "HP:6": ("HP:6", 0, "HP:6", 0, 0), "HP:10": ("", -1, "", 1, 1), "HP:11": ("", -1, "", 0, 0),
    }


def test_empty_table(spark):
    assert term_hierarchy(terms(spark, [])).count() == 0
    assert live_edges(terms(spark, [("HP:1", None, True, None, 0)])).count() == 0


def test_levels_are_logarithmic(spark, monkeypatch):
    """A chain whose neighbours have unrelated ids: a block of neighbouring ids holds none of its steps."""
    n = 20_000
    name = lambda i: f"{i * 7919 % n:06d}"
    df = spark.createDataFrame([(name(i), [name(i - 1)] if i else []) for i in range(n)], "identifier string, parents array<string>")
    levels = []
    kept = module.contract
    monkeypatch.setattr(module, "contract", lambda laid: levels.append(1) or kept(laid))
    whole, graph, left = module._levels(df, 200, 100)
    assert left <= 100 and len(levels) <= 1.5 * math.log(n / 100) / math.log(4 / 3) and graph.count() == left
    assert whole.agg({"steps": "max"}).first()[0] < n and whole.count() == n
