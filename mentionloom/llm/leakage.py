"""Evaluation texts in training text: rare n-gram seeds, then Smith-Waterman alignment.

The n-grams of all items are looked up in all documents, with their places. Seeds are the rarer half of each item's n-grams,
by the number of documents that hold them. Documents that share seeds with an item are aligned with it word by word (local
alignment with gaps), in windows around the seeds, as the rest of a document can hold nothing of the item but scattered
words; a second stretch close before or after the first counts too. A document is a case if the aligned words are at least
``share`` of the item's words. An alignment takes memory in proportion to its window.

Defined cases: null, empty and blank texts of either side give no case; repeated rows of a document give one case; items
with equal wording are each reported. Windows cover all seeds, whatever the length of the text. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.llm.wording import Hasher, grams, tokens
from mentionloom.session import cut

GRAM = 3
#: an alignment is tried from this share of an item's seeds on, and from two seeds where it has as many
SEED_SHARE = 0.12
SHARE = 0.55
#: the second stretch may stand so many words away, and needs so many words
CLOSE_WORDS = 60
LEAST_STRETCH = 6
#: up to so many item n-grams (8 bytes each) are sent to the tasks; beyond, documents' n-grams are joined by shuffle
BROADCAST_GRAMS = 1_000_000
#: shares of the documents by which a frequent seed is joined
SHARES = 16


def _places(texts: list[str], hasher: Hasher, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, place) of all n-grams; a text of fewer words is one n-gram."""
    ids = [hasher(tokens(t)) for t in texts]
    size = np.array([len(x) for x in ids], np.int64)
    owner = np.repeat(np.arange(len(ids)), size)
    start = np.cumsum(size) - size
    every = np.concatenate(ids) if ids else np.empty(0, np.int64)
    found = grams(every, n) if len(every) >= n else np.empty(0, np.int64)
    at = np.flatnonzero(owner[: len(found)] == owner[n - 1 :][: len(found)])
    small = np.flatnonzero((size > 0) & (size < n))
    whole = np.array([grams(ids[i], n)[0] for i in small], np.int64)
    return np.concatenate((owner[at], small)), np.concatenate((found[at], whole)), np.concatenate((at - start[owner[at]], np.zeros(len(small), np.int64)))


def _grams_of(rows: DataFrame, key: str, n: int, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, gram, places): the distinct n-grams of each text, or those of them that are wanted."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        hasher, wanted = Hasher(), sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                owner, found, place = _places(part.column(1).to_pylist(), hasher, n)
                if wanted is not None:
                    hit = wanted[np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)] == found if len(wanted) else np.zeros(len(found), bool)
                    owner, found, place = owner[hit], found[hit], place[hit]
                order = np.lexsort((place, found, owner))
                owner, found, place = owner[order], found[order], place[order]
                first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])))) if len(owner) else np.empty(0, np.int64)
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[first])), pa.array(found[first]), places], names=[key, "gram", "places"])

    return rows.filter("text is not null").select(key, "text").mapInArrow(run, f"{key} bigint, gram bigint, places array<int>")


def hits(documents: DataFrame, item_grams: DataFrame, n: int = GRAM, broadcast: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, gram, places) of all n-grams of the items in all documents."""
    distinct = cut(item_grams.select("gram").distinct())
    if distinct.count() <= broadcast:
        return _grams_of(documents, "doc_id", n, np.sort(distinct.toArrow().column("gram").to_numpy()))
    return _grams_of(documents, "doc_id", n).join(distinct, "gram").select("doc_id", "gram", "places")


def seeds(item_grams: DataFrame, found: DataFrame) -> DataFrame:
    """(item_id, gram, n_seeds): of each item the n-grams that no more documents hold than its median n-gram; an n-gram of no document is the rarest."""
    held = item_grams.join(found.groupBy("gram").agg(F.count("*").alias("documents")), "gram", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
    w = Window.partitionBy("item_id")
    half = held.withColumn("median", F.percentile("documents", F.lit(0.5)).over(w)).filter("documents <= median")
    return half.select("item_id", "gram", F.count("*").over(w).alias("n_seeds"))


def candidates(documents: DataFrame, items: DataFrame, n: int = GRAM, broadcast: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, item_id, places): documents that share enough seeds with an item, and where."""
    item_grams = cut(_grams_of(items, "item_id", n).select("item_id", "gram").distinct())
    found = cut(hits(documents, item_grams, n, broadcast))
    chosen = seeds(item_grams, found)
    if item_grams.count() <= broadcast:  # seeds are no more than that
        met = found.join(F.broadcast(chosen), "gram")
    else:
        spread = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        met = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int")).join(spread, ["gram", "part"])
    shared = met.groupBy("doc_id", "item_id", "n_seeds").agg(F.countDistinct("gram").alias("n"), F.flatten(F.collect_list("places")).alias("places"))
    return shared.filter(F.col("n") >= F.greatest(F.least(F.lit(2), F.col("n_seeds")), SEED_SHARE * F.col("n_seeds"))).select("doc_id", "item_id", "places")


_ONE = np.int64(1) << np.int64(32)


def best_end(item: np.ndarray, doc: np.ndarray, match: int = 2, miss: int = 1, gap: int = 1) -> tuple[int, int, int, int]:
    """(score, matching words, item end, doc end) of the best local alignment, ends exclusive; of equal scores the one with more matches.

    A cell is the score and, beneath it, the matches on the way there, so that one row is all that is kept.
    """
    if not len(item) or not len(doc):
        return 0, 0, 0, 0
    step = gap * _ONE * np.arange(len(doc) + 1)
    row = np.zeros(len(doc) + 1, np.int64)
    t = np.zeros(len(doc) + 1, np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(item, 1):
        np.maximum(row[:-1] + np.where(doc == word, match * _ONE + 1, -miss * _ONE), row[1:] - gap * _ONE, out=t[1:])
        t[t < _ONE] = 0
        row = np.maximum.accumulate(t + step) - step
        row[row < _ONE] = 0
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i, j)
    return best[0] >> 32, best[0] & 0xFFFFFFFF, best[1], best[2]


def best_ends(items: list[np.ndarray], docs: list[np.ndarray], match: int = 2, miss: int = 1, gap: int = 1) -> np.ndarray:
    """Matching words of the best local alignment of each pair: ``best_end`` for many pairs at once, shorter ones filled up with what matches nothing."""
    m, n = max(map(len, items)), max(map(len, docs))
    words, texts = np.zeros((len(items), m), np.int64), np.zeros((len(docs), n), np.int64)
    inside, there = np.zeros((len(items), m), bool), np.zeros((len(docs), n), bool)
    for k, (a, b) in enumerate(zip(items, docs, strict=True)):
        words[k, : len(a)], inside[k, : len(a)] = a, True
        texts[k, : len(b)], there[k, : len(b)] = b, True
    step = gap * _ONE * np.arange(n + 1)
    row, t = np.zeros((len(docs), n + 1), np.int64), np.zeros((len(docs), n + 1), np.int64)
    best = np.zeros(len(docs), np.int64)
    for i in range(m):
        same = (texts == words[:, i : i + 1]) & there & inside[:, i : i + 1]
        np.maximum(row[:, :-1] + np.where(same, match * _ONE + 1, -miss * _ONE), row[:, 1:] - gap * _ONE, out=t[:, 1:])
        t *= t >= _ONE
        row = np.maximum.accumulate(t + step, axis=1) - step
        row *= row >= _ONE
        best = np.maximum(best, row.max(axis=1))
    return best & 0xFFFFFFFF


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment: (matching words, item from, item to, doc from, doc to), ends exclusive."""
    score, matched, i, j = best_end(item, doc)
    if not score:
        return 0, 0, 0, 0, 0
    _, _, back_i, back_j = best_end(item[:i][::-1], doc[:j][::-1])
    return matched, i - back_i, i, j - back_j, j


def held_share(item: np.ndarray, doc: np.ndarray, enough: float = 2.0) -> float:
    """Share of the item's words that stand in the document in order, in one stretch or two close ones; no second one is sought from ``enough`` on."""
    score, matched, _, _ = best_end(item, doc)
    if not score or matched >= enough * len(item):
        return matched / max(1, len(item))
    matched, i0, i1, j0, j1 = align(item, doc)
    before = best_end(item[:i0], doc[max(0, j0 - CLOSE_WORDS - len(item)) : j0])
    after = best_end(item[i1:], doc[j1 : j1 + CLOSE_WORDS + len(item)])
    more = [a[1] for a in (before, after) if a[1] >= LEAST_STRETCH]
    return (matched + max(more, default=0)) / len(item)


def windows(places: np.ndarray, item_words: int, doc_words: int) -> list[tuple[int, int]]:
    """Stretches of a document around the seeds of an item: what can be aligned with it from a seed on, and a second stretch beside that; long ones are cut with that overlap."""
    reach = 3 * item_words + CLOSE_WORDS + GRAM
    out: list[list[int]] = []
    for p in np.unique(places):
        a, b = max(0, int(p) - reach), min(doc_words, int(p) + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    size, overlap = 8 * reach, 4 * reach
    return [(s, min(b, s + size)) for a, b in out for s in range(a, max(a + 1, b - overlap), size - overlap)]


def held_in_windows(item: np.ndarray, doc: np.ndarray, places: np.ndarray, enough: float = 2.0) -> float:
    best = 0.0
    for a, b in windows(places, len(item), len(doc)):
        best = max(best, held_share(item, doc[a:b], enough))
        if best >= enough:
            break
    return best


def _batches_of(rows: list[tuple], cells: int = 30_000):
    """Windows of like length that are aligned at once."""
    start = 0
    while start < len(rows):
        end = start + 1
        while end < len(rows) and (end + 1 - start) * len(rows[end][3]) <= cells:
            end += 1
        yield rows[start:end]
        start = end


def leaked(documents: DataFrame, items: DataFrame, n: int = GRAM, share: float = SHARE, broadcast: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, item_id, held) of every document that holds at least ``share`` of an item's wording; ``held`` is what was found of it when that was reached."""
    pairs = candidates(documents, items, n, broadcast)
    worded = items.filter("text is not null").select("item_id", F.col("text").alias("item_text"))
    asked = cut(pairs.join(worded, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item_text", "places")).alias("asked")))
    both = documents.select("doc_id", F.col("text").alias("doc_text")).join(asked, "doc_id").select("doc_id", "doc_text", "asked")

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                doc, doc_id = hasher(tokens(batch.column(1)[i].as_py())), batch.column(0)[i].as_py()
                asked = [(a["item_id"], hasher(tokens(a["item_text"])), np.array(a["places"], np.int64)) for a in batch.column(2)[i].as_py()]
                rows += [(doc_id, item_id, item, doc[a:b]) for item_id, item, places in asked for a, b in windows(places, len(item), len(doc))]
            rows.sort(key=lambda r: (len(r[3]), len(r[2])))
            held = []
            for part in _batches_of(rows):
                for (_, _, item, doc), matched in zip(part, best_ends([r[2] for r in part], [r[3] for r in part]), strict=True):
                    held.append(matched / len(item) if matched >= share * len(item) else held_share(item, doc, share))
            ids, item_ids = [r[0] for r in rows], [r[1] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(item_ids, pa.int64()), pa.array(held, pa.float64())], names=["doc_id", "item_id", "held"])

    aligned = both.mapInArrow(run, "doc_id bigint, item_id bigint, held double")
    return aligned.filter(F.col("held") >= share).groupBy("doc_id", "item_id").agg(F.max("held").alias("held"))
