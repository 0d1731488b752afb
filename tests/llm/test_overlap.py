import random

import numpy as np

from mentionloom.llm import overlap as O

SCHEMA = "article_row bigint, pmc_id string, split string, source string, full_text array<struct<section_type:string,offset:int,text:string>>, class string"
WORDS = [f"w{i}" for i in range(4000)]
STOCK = "consent was given by all carers and the regional review panel of the network approved the protocol before the first visit took place there"


def article(row, pmc, split, texts):
    return (row, pmc, split, "s", None if texts is None else [("A", 0, t) for t in texts], "clash")


def pairs(spark, rows):
    return {tuple(r) for r in O.split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}


def text(seed, n=120):
    return random.Random(seed).choices(WORDS, k=n)


def edited(words, every):
    return [("also" if i % every == 5 else w) for i, w in enumerate(words)]


def test_copies_edits_order_markup_and_stock(spark):
    a, b, c = text(1), text(2), text(3)
    join = " ".join
    rows = [
        article(1, "PMC1", "train", [join(a[:60]), join(a[60:])]), article(2, "PMC2", "dev", [join(a[60:]).upper(), "<b>" + join(a[:60]) + "</b>"]), article(3, "PMC3", "a", [join(edited(a, 30))]),
        article(4, "PMC4", "train", [join(b), STOCK]), article(5, "PMC5", "dev", [join(c), STOCK]), article(6, "PMC6", "train", [join(edited(a, 41))]),
        article(7, "PMC-0007", "train", None), article(8, " pmc 7.2", "dev", None), article(9, None, "dev", None), article(10, "PMC10", "dev", [None, ""]), article(11, "PMC11", None, [join(a[:40] + c[40:])]),
    ]
    assert pairs(spark, rows) == {(1, 2), (1, 3), (2, 6), (3, 6), (7, 8)}


def test_many_near_copies_are_all_linked(spark):
    base = text(9, 200)
    rows = [article(i, None, "train" if i % 2 else "dev", [" ".join(edited(base, 31 + i))]) for i in range(14)]
    assert pairs(spark, rows) == {(i, j) for i in range(14) for j in range(i + 1, 14) if (i + j) % 2}


def test_empty_and_short(spark):
    assert pairs(spark, []) == set()
    assert pairs(spark, [article(1, None, "train", ["one two"]), article(2, None, "dev", ["One, two!"]), article(3, None, "dev", ["one three"])]) == {(1, 2)}


def test_shared_spans_share_anchors():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 1 << 31, 300).astype(np.uint32), r.integers(0, 1 << 31, 300).astype(np.uint32)
    b[50:90] = a[100:140]
    at = {tuple(a[i : i + 8]) for i in O.anchors(a)} & {tuple(b[i : i + 8]) for i in O.anchors(b)}
    assert at and O.coverage(a, b) == 40 / 300


def test_report(spark):
    rows = [article(1, "PMC1", "train", None), article(2, "PMC1", "dev", None), article(3, "PMC3", "dev", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in O.overlap_report(df, O.split_overlaps(df)).collect()] == [("dev", "s", 2, 1)]


def test_short_near_copies_and_long_stock_openings(spark):
    """Every pair of near copies of short texts, and of texts behind one long opening, is found that plain comparison of all pairs finds."""
    r = random.Random(5)
    rows, n = [], 0
    for size in (8, 9, 10, 12, 14, 16, 18, 20, 24, 32, 64, 65, 90):
        for k in range(15):
            words = [f"z{size}x{k}x{i}" for i in range(size)]
            other = words[:-1] + ["else"] if k % 3 else edited(words, max(9, size // 2))
            rows += [article(2 * n, None, "train", [" ".join(words)]), article(2 * n + 1, None, "dev", [" ".join(other)])]
            n += 1
    opening = text(77, 40)
    for k in range(60):
        words = opening + [r.choice(WORDS) for _ in range(30)]
        rows += [article(2 * n, None, "train", [" ".join(words)]), article(2 * n + 1, None, "dev", [" ".join(words[:-2])])]
        n += 1
    ids = {row[0]: np.array([hash(w) & 0xFFFFFFFF for w in row[4][0][2].split()], np.uint32) for row in rows}
    train, dev = [i for i in ids if i % 2 == 0], [i for i in ids if i % 2]
    share = O.coverages([ids[a] for a in train for _ in dev], [ids[b] for _ in train for b in dev])
    true = {(min(a, b), max(a, b)) for (a, b), s in zip(((a, b) for a in train for b in dev), share, strict=True) if s >= O.COVERAGE}
    assert len(true) >= 200 and pairs(spark, rows) == true


def test_crowd_of_copies_and_large_classes(spark, monkeypatch):
    monkeypatch.setattr(O, "CHUNK", 4)
    base = text(3, 300)
    rows = [article(i, None, "train" if i % 2 else "dev", [" ".join(edited(base, 40 + i))]) for i in range(60)]
    assert pairs(spark, rows) == {(i, j) for i in range(60) for j in range(i + 1, 60) if (i + j) % 2}
    same = [article(i, "PMC9" if i % 3 else None, "train" if i % 2 else "dev", [" ".join(base)]) for i in range(40)]
    got = O.split_overlaps(spark.createDataFrame(same, SCHEMA)).collect()
    assert len(got) == 400 and len({tuple(r) for r in got}) == 400


def test_ranks_follow_common_prefixes():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 31, 400).astype(np.uint32)
    b = np.concatenate((r.integers(0, 1 << 31, 33).astype(np.uint32), a[100:150], r.integers(0, 1 << 31, 90).astype(np.uint32)))
    (ha, ta), (hb, tb) = O.ranks(a, np.array([100, 101])), O.ranks(b, np.array([33, 34]))
    assert (ha == hb).all() and ha[0] != ha[1] and (ta.view(np.uint64) >> np.uint64(32) == tb.view(np.uint64) >> np.uint64(32)).all() and (ta != tb).all()
