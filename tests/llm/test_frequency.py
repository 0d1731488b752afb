import random

import numpy as np

import pyarrow as pa

from mentionloom.llm import frequency
from mentionloom.llm.frequency import normal_text, pack, term_frequencies, unpack

SCHEMA = "candidate_id bigint, pmc_id string, text string, identifier string, term string, n_occ bigint"


def counted(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r["field"], r["term"]): (r["n_occ"], r["n_articles"], r["mark"]) for r in term_frequencies(df, **more).collect()}


def test_bitmaps_round_trip_sparse_and_dense():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 1 << 22, n)) for n in (1, 5, 3000)] + [np.arange(70_000), np.array([65535, 65536, (1 << 22) - 1])]
    bitmaps = pack(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets), len(sets))
    row, low = unpack(bitmaps)
    for i, s in enumerate(sets):
        assert np.array_equal(np.sort(low[row == i]), s)
    assert len(bitmaps[3].as_py()) < 70_000 * 2
    assert len(pack(np.empty(0, np.int64), np.empty(0, np.int64), 0)) == 0


def test_terms_marks_and_repeats(spark):
    rows = [(i, f"PMC{i}", "ﬁxed\n  Gait", "HP:1;HP:1; HP:2", None, 0) for i in range(1, 41)]
    rows += rows[:5]  # delivered again
    rows += [(100, None, "ＦＩＸＥＤ gait", ";", None, 0), (101, "odd id", None, None, None, 0), (102, "PMC1", "", " ", None, 0), (103, "PMC2", "rare", "HP:1", None, 0), (None, "PMC3", "gone", "HP:9", None, 0)]
    assert counted(spark, rows) == {("text", "fixed gait"): (41, 40, "common"), ("text", "rare"): (1, 1, "rare"), ("identifier", "HP:1"): (81, 40, "common"), ("identifier", "HP:2"): (40, 40, "common")}


def test_random_tables_against_counting(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 1 << 24), f"PMC{r.randint(1, 1 << 26)}", r.choice("abcde") * 3, ";".join(r.choices(["x", "y", "z"], k=r.randint(0, 3))), None, 0) for _ in range(3000)]
    rows = list({x[0]: x for x in rows}.values())
    occ, art = {}, {}
    for c, p, t, ids, *_ in rows:
        for term in [("text", normal_text(t)), *(("identifier", x) for x in ids.split(";") if x)]:
            occ[term] = occ.get(term, 0) + 1
            art.setdefault(term, set()).add(p)
    got = counted(spark, rows + rows[:500])
    assert {k: v[:2] for k, v in got.items()} == {k: (occ[k], len(art[k])) for k in occ}


def test_empty_table_and_long_text(spark):
    assert counted(spark, []) == {}
    assert counted(spark, [(1, "PMC1", "x" * 200_000, None, None, 0)]) == {("text", "x" * 200_000): (1, 1, "rare")}


def postings(tasks, ids_of):
    """What many tasks send of one term, batch by batch."""
    for task in range(tasks):
        ids = ids_of(task)
        more = np.array([[ids[0], 2]], np.int64).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(["text"] * 2), pa.array(["hot", "hot"]), pa.array([0, 0], pa.int32()), pa.array([0, 0], pa.int64()), pa.array(pack(np.zeros(len(ids), np.int64), ids, 1).to_pylist() * 2), pa.array([more, None], pa.binary())], names=["field", "term", "kind", "bucket", "bitmap", "more"])


def test_a_term_of_every_row_takes_the_space_of_one_bitmap():
    import tracemalloc

    r = np.random.default_rng(3)
    tracemalloc.start()
    rows = [b for b in frequency._cardinality(postings(1000, lambda task: np.arange(task * 4000, task * 4000 + 4000) if task % 2 else np.unique(r.integers(0, 1 << 22, 20_000))))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == 1 and rows[0].num_rows == 1 and 3_900_000 < rows[0].column(2)[0].as_py() < (1 << 22) + 2001 and peak < 150_000_000


def test_uniting_twice_counts_the_same():
    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 22, n)) for i, n in enumerate((10, 5000, 300_000, 300_000, 70_000))]
    whole = [b for b in frequency._cardinality(postings(5, lambda task: sets[task]))]
    parts = [x for task in range(5) for x in frequency._unite(postings(1, lambda _, task=task: sets[task]))]
    again = [b for b in frequency._cardinality(iter(parts))]
    assert whole[0].to_pylist() == again[0].to_pylist() == [{"field": "text", "term": "hot", "n_occ": len(np.unique(np.concatenate(sets))) + 2 * len({s[0] for s in sets}), "n_articles": 0}]


def test_shares_of_tasks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(frequency, "HEAVY_BYTES", 8)
    rows = [(i, f"PMC{i % 700 + 1}", "hot" if i % 3 else f"t{i % 50}", "x;x", None, 0) for i in range(3000)]
    got = counted(spark, rows + rows[::7])
    assert got["text", "hot"][:2] == (2000, 700) and got["identifier", "x"][:2] == (6000, 700) and sum(v[0] for k, v in got.items() if k[0] == "text") == 3000
