import random

import numpy as np

from mentionloom.llm import leakage as L
from mentionloom.llm.wording import tokens

VOCABULARY = [f"{a}{b}" for a in ("bren", "col", "dat", "fer", "gim", "hul", "jor", "kel") for b in ("ak", "em", "in", "os", "ul", "yr", "av", "ot")]


def make(seed, n):
    return random.Random(seed).choices(VOCABULARY, k=n)


def test_documents(spark):
    item, other, filler = make(1, 60), make(2, 60), make(3, 80)
    join = " ".join
    swapped = [("zzz" if i % 10 == 4 else w) for i, w in enumerate(item)]
    docs = {
        1: join(filler[:40] + item + filler[40:]), 2: join(item).upper().replace(" ", ",\n> "), 3: join(filler[:20] + swapped + filler[20:]), 4: join(item[:24] + filler[:30] + item[24:48]), 5: join(filler + item[:12]),
        6: join(random.Random(1).sample(item, 60)), 7: "<b>" + join(item[:20]) + "</b> " + join(item[20:45]), 8: join(filler) * 300 + " " + join(other), 9: None, 10: "", 11: "  ",
        12: join(item[:30]) + " " + " ".join(w[:2] + "-\n" + w[2:] for w in item[30:]),
    }
    d = spark.createDataFrame([(k, v, "x") for k, v in docs.items()] + [(1, docs[1], "y")], "doc_id bigint, text string, held string")
    i = spark.createDataFrame([(100, join(item)), (200, join(other)), (300, None), (400, "")], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in L.leaked(d, i).collect()} == {(1, 100), (2, 100), (3, 100), (4, 100), (7, 100), (8, 200), (12, 100)}
    assert L.leaked(d.limit(0), i).count() == 0 and L.leaked(d, i.limit(0)).count() == 0


def test_scripts_without_spaces(spark):
    item = "登记案例中一名牧羊人三十五岁有角膜混浊其表妹只在七周内出现过关节僵硬请判断是否成立"
    d = spark.createDataFrame([(1, "讨论。" + item + "。乳酸正常。"), (2, "乳酸为正常值，随访八个月。")], "doc_id bigint, text string")
    i = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    assert [tuple(r)[:2] for r in L.leaked(d, i).collect()] == [(1, 5)]


def test_alignment_against_plain_dynamic_programme():
    r = random.Random(4)
    for _ in range(30):
        a, b = [r.randint(0, 5) for _ in range(r.randint(1, 9))], [r.randint(0, 5) for _ in range(r.randint(1, 12))]
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        hits, i0, i1, j0, j1 = L.align(np.array(a), np.array(b))
        best = max(map(max, h))
        assert (hits > 0) == (best > 0) and 0 <= i0 <= i1 <= len(a) and 0 <= j0 <= j1 <= len(b) and 2 * hits >= best


def test_tokens_see_through_typography():
    assert tokens("Lеft <b>show</b>n GZ‑45 circ-\n> umference &amp; Straße") == tokens("left shown gz-45 circumference straße")


def test_windows_hold_what_the_whole_text_holds():
    r = np.random.default_rng(6)
    for _ in range(60):
        item = r.integers(0, 1 << 40, int(r.integers(8, 60)))
        doc = r.integers(0, 1 << 40, int(r.integers(50, 3000)))
        for _ in range(int(r.integers(1, 4))):
            a, b = np.sort(r.integers(0, len(item), 2))
            at = int(r.integers(0, len(doc) - (b - a)))
            doc[at : at + b - a] = item[a:b]
        own = L.grams(item, L.GRAM)
        places = np.flatnonzero(np.isin(L.grams(doc, L.GRAM), own))
        whole, seen = L.held_share(item, doc), L.held_in_windows(item, doc, places)
        assert seen >= whole or whole * len(item) < 2 * L.LEAST_STRETCH


def test_memory_follows_the_window():
    import tracemalloc

    r = np.random.default_rng(7)
    item, doc = r.integers(0, 50, 100), r.integers(0, 50, 5_000_000)
    doc[4_000_000:4_000_100] = item
    tracemalloc.start()
    held = L.held_in_windows(item, doc, np.array([1, 2_000_000, 4_000_000, 4_999_999]))
    assert held == 1.0 and tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()
    assert len(L.windows(np.arange(0, 100_000, 7), 100, 100_000)) < 200 and max(b - a for a, b in L.windows(np.arange(0, 100_000, 7), 100, 100_000)) < 10_000


def test_joined_grams_give_the_same(spark):
    item, filler = make(1, 60), make(3, 80)
    d = spark.createDataFrame([(i, " ".join(filler[:i] + (item if i % 2 else item[:9]) + filler[i:])) for i in range(20)], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(make(8, 40)))], "item_id bigint, text string")
    got = [{(r["doc_id"], r["item_id"]) for r in L.leaked(d, i, broadcast=b).collect()} for b in (10**6, 0)]
    assert got[0] == got[1] == {(k, 1) for k in range(1, 20, 2)}


def test_many_alignments_at_once():
    r = np.random.default_rng(9)
    items, docs = [[r.integers(0, 4, int(r.integers(1, most))) for _ in range(50)] for most in (12, 40)]
    assert L.best_ends(items, docs).tolist() == [L.best_end(a, b)[1] for a, b in zip(items, docs, strict=True)]
