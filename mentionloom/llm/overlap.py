"""Records of evaluation splits that also stand, exactly or nearly, in the training split.

The running texts become token sequences; equal sequences of one side are one class. Every class gives the suffixes that
start at its anchors: all of them in texts of up to ``DENSE_WORDS``, in longer ones the smallest token hashes of a sliding
window, the same in any shared span. The suffixes of all classes make one suffix array, partitioned by their first ``SPAN``
words and sorted by those and by the ranks of blocks of doubling length to the end of the text, hashes standing for ranks:
suffixes that agree further stand together, however far, and no two that share ``SPAN`` words are in different partitions.
Neighbours of opposite sides reveal shared spans, and so does the first class of each side among those that share a prefix,
so that a crowd of copies hangs together. Pairs of classes that share enough of the anchors of the smaller one are candidates.

For each candidate the shared spans of both texts are merged into coverage of either record, and pairs with enough of it
are links; links through a third text are tried as well until none is new. The result of the operator are links of classes
with their numbers of members; ``split_overlaps`` alone expands them to pairs of rows.

Defined cases: null, empty and blank texts match nothing by text; rows without a number match nothing by number; texts of
fewer than ``SPAN`` words match by equality alone; repeated deliveries are rows of their own; rows with a null split count
as evaluation. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.llm.wording import Hasher, grams, tokens
from mentionloom.session import cut

SPAN = 8
ANCHOR_GRAM = 4
ANCHOR_WINDOW = 8
#: texts of up to so many words give all their suffixes
DENSE_WORDS = 64
#: share of the smaller text's anchors that a pair of classes must have in common to be tried
LEAST_SHARED = 0.08
#: share of either record's words that lie in shared spans
COVERAGE = 0.65
#: members of a class that are expanded at once
CHUNK = 1000


def record_number(c: Column) -> Column:
    """The digits of a PMC number, however written: ``PMCID: PMC-0123.2`` is 123; null if there is none."""
    digits = F.regexp_extract(F.upper(F.translate(c, "０１２３４５６７８９", "0123456789")), r"^\W*(?:PMC\s*ID\W*)?(?:PMC\W*)?0*([0-9]+)(?:\.[0-9]+)?\W*$", 1)
    return F.when(digits != "", digits)


def token_sequences(articles: DataFrame) -> DataFrame:
    """(article_row, train, print, ids) of every row whose text has words."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            rows, sides, prints, lists = [], [], [], []
            for row, side, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = [w for t in texts or [] for w in tokens(t)]
                if words:
                    ids = (hasher(words) & 0xFFFFFFFF).astype(np.uint32)
                    rows.append(row), sides.append(side), prints.append(xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)), lists.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sides, pa.bool_()), pa.array(prints, pa.int64()), pa.array(lists, pa.binary())], names=["article_row", "train", "print", "ids"])

    side = F.coalesce(F.col("split") == "train", F.lit(False)).alias("train")
    return articles.filter("full_text is not null").select("article_row", side, F.col("full_text.text").alias("texts")).mapInArrow(run, "article_row bigint, train boolean, print bigint, ids binary")


def anchors(ids: np.ndarray, n: int = ANCHOR_GRAM, window: int = ANCHOR_WINDOW) -> np.ndarray:
    """Starts of suffixes of at least ``SPAN`` words: all of a short text, else of the n-grams with the smallest hash of each window of n-grams."""
    if len(ids) <= DENSE_WORDS:
        return np.arange(len(ids) - SPAN + 1) if len(ids) >= SPAN else np.empty(0, np.int64)
    h = grams(ids.astype(np.int64), n)
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    at = np.unique(np.arange(len(views)) + views.argmin(1))
    return at[at <= len(ids) - SPAN]


_BASE = np.uint64(0x9E3779B97F4A7C15)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base))), dtype=np.uint64)


def ranks(ids: np.ndarray, at: np.ndarray, lengths: tuple[int, ...] = (16, 32, 64)) -> tuple[np.ndarray, np.ndarray]:
    """(head, tail) of the suffixes at ``at``: equal heads mean equal first ``SPAN`` words; tails hold 16 bits for each block of doubling length and for all the rest."""
    n = len(ids)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n], dtype=np.uint64)))
    back = _powers(_INVERSE, n)[at]  # equal blocks are equal wherever they stand

    def block(end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[at]) * back
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(29)

    head = block(at + SPAN).view(np.int64)
    tail = np.zeros(len(at), np.uint64)
    for end in [*(np.minimum(at + length, n) for length in lengths), np.full(len(at), n)]:
        tail = tail << np.uint64(16) | block(end) >> np.uint64(48)
    return head, tail.view(np.int64)


def suffixes(classes: DataFrame) -> DataFrame:
    """(head, tail, class, train, n_anchors): the anchored suffixes by their ranks."""

    def run(batches):
        for batch in batches:
            heads, tails, owner, side, size = [], [], [], [], []
            for c, train, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(raw, np.uint32)
                at = anchors(ids)
                if len(at):
                    head, tail = ranks(ids, at)
                    heads.append(head), tails.append(tail), owner.append(c), side.append(train), size.append(len(at))
            if size:
                columns = [np.concatenate(heads), np.concatenate(tails), np.repeat(owner, size), np.repeat(side, size), np.repeat(size, size).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["head", "tail", "class", "train", "n_anchors"])

    return classes.select("class", "train", "ids").mapInArrow(run, "head bigint, tail bigint, class bigint, train boolean, n_anchors int")


def _neighbours(batches):
    """Of the sorted suffixes: how many neighbours of opposite sides, and first classes of the other side, have the same head, by pair of classes."""
    held = None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        n_old = 0
        if held is not None:
            n_old = len(held[0])
            new = [np.concatenate(pair) for pair in zip(held, new, strict=True)]
        head, owner, side, size, first_train, first_other = new
        n = len(owner)
        at = np.arange(n)
        last = [np.maximum.accumulate(np.where(side == s, at, -1)) for s in (False, True)]
        before = np.where(side, last[0], last[1])
        ahead = [np.minimum.accumulate(np.where(side == s, at, n)[::-1])[::-1] for s in (False, True)]
        after = np.where(side, ahead[0], ahead[1])
        # what was held has its neighbours before it already, and what comes later is met from the other side
        back, on = at[(before >= 0) & (at >= n_old)], at[(after < n) & (np.minimum(after, n - 1) >= n_old)]
        i, j = np.concatenate((back, on)), np.concatenate((before[back], after[on]))
        same = head[i] == head[j]
        i, j = i[same], j[same]
        train, other = np.where(side[i], owner[i], owner[j]), np.where(side[i], owner[j], owner[i])
        least = np.minimum(size[i], size[j])
        hub = np.where(side, first_other, first_train)
        met = at[(hub >= 0) & (at >= n_old)]
        train = np.concatenate((train, np.where(side[met], owner[met], hub[met])))
        other = np.concatenate((other, np.where(side[met], hub[met], owner[met])))
        least = np.concatenate((least, size[met]))
        if len(train):
            order = np.lexsort((other, train))
            train, other, least = train[order], other[order], least[order]
            start = np.flatnonzero(np.concatenate(([True], (train[1:] != train[:-1]) | (other[1:] != other[:-1]))))
            yield pa.RecordBatch.from_arrays([pa.array(train[start]), pa.array(other[start]), pa.array(np.diff(np.append(start, len(train))).astype(np.int64)), pa.array(np.minimum.reduceat(least, start).astype(np.int32))], names=["train_class", "other_class", "n", "least"])
        keep = np.unique(np.array([x for x in (last[0][-1], last[1][-1]) if x >= 0], np.int64)) if n else np.empty(0, np.int64)
        held = [c[keep] for c in new]


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """(train_class, other_class) of classes of which neighbouring suffixes share enough."""
    group = Window.partitionBy("head")
    near = suffixes(classes).repartition("head").sortWithinPartitions("head", "tail", "class")
    first = lambda train: F.coalesce(F.min(F.when(F.col("train") == F.lit(train), F.col("class"))).over(group), F.lit(-1))
    near = near.withColumn("first_train", first(True)).withColumn("first_other", first(False)).filter("first_train >= 0 AND first_other >= 0")
    pairs = near.sortWithinPartitions("head", "tail", "class").select("head", "class", "train", "n_anchors", "first_train", "first_other").mapInArrow(_neighbours, "train_class bigint, other_class bigint, n bigint, least int")
    return pairs.groupBy("train_class", "other_class").agg(F.sum("n").alias("n"), F.min("least").alias("least")).filter(F.col("n") >= LEAST_SHARED * F.col("least")).select("train_class", "other_class")


def coverages(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each pair of texts the smaller share of either that lies in spans of ``SPAN`` or more words that the other holds too."""

    def spans(texts):
        size = np.array([len(t) for t in texts])
        ids = np.concatenate(texts).astype(np.int64) if size.sum() else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), size)
        if len(ids) < SPAN:
            return size, owner, np.empty(0, np.int64), np.empty(0, np.uint64)
        h = grams(ids, SPAN)
        at = np.flatnonzero(owner[: len(h)] == owner[SPAN - 1 :])
        return size, owner, at, h.view(np.uint64)[at] ^ (owner[at].astype(np.uint64) + np.uint64(1)) * _BASE

    parts = [spans(a), spans(b)]
    shares = []
    for (size, owner, at, own), (_, _, _, there) in (parts, parts[::-1]):
        hit = at[np.isin(own, there)]
        edge = np.zeros(len(owner) + SPAN + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + SPAN, -1)
        held = np.cumsum(edge)[: len(owner)] > 0
        shares.append(np.bincount(owner, held, minlength=len(size)) / np.maximum(size, 1))
    return np.minimum(*shares)


def coverage(a: np.ndarray, b: np.ndarray) -> float:
    return float(coverages([a], [b])[0])


def _verified(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    text = classes.select("class", "ids")
    both = pairs.join(text.select(F.col("class").alias("train_class"), F.col("ids").alias("a")), "train_class").join(text.select(F.col("class").alias("other_class"), F.col("ids").alias("b")), "other_class")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                a, b = ([np.frombuffer(x, np.uint32) for x in part.column(k).to_pylist()] for k in (2, 3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["train_class", "other_class"]).filter(pa.array(coverages(a, b) >= least))

    return both.select("train_class", "other_class", "a", "b").mapInArrow(run, "train_class bigint, other_class bigint")


def linked_classes(classes: DataFrame, texts: DataFrame, least: float = COVERAGE) -> DataFrame:
    """(train_class, other_class) of all links between different texts; ``texts`` has the tokens of at least all classes."""
    tried = cut(candidate_pairs(classes))
    links = cut(_verified(tried, texts, least))
    while True:
        via = links.select(F.col("train_class").alias("c"), "other_class")
        sisters = links.join(via, "other_class").filter("train_class <> c").select("train_class", "c").distinct()
        more = sisters.join(via, "c").select("train_class", "other_class").distinct()
        more = cut(more.join(tried, ["train_class", "other_class"], "left_anti"))
        if more.isEmpty():
            return links
        tried = cut(tried.unionByName(more))
        links = cut(links.unionByName(_verified(more, texts, least)))


def linked_records(articles: DataFrame, least: float = COVERAGE) -> tuple[DataFrame, DataFrame]:
    """Links (train_class, other_class, n_train, n_other) of classes of rows with one text and one number, and members (article_row, class)."""
    rows = cut(token_sequences(articles))
    side = F.coalesce(F.col("split") == "train", F.lit(False)).alias("train")
    every = articles.select("article_row", side, record_number(F.col("pmc_id")).alias("number")).join(rows.select("article_row", "print"), "article_row", "left")
    keys = ["train", "number", "print"]
    kinds = cut(every.filter("number IS NOT NULL OR print IS NOT NULL").groupBy(*keys).agg(F.min("article_row").alias("class"), F.count("*").alias("members")))
    same = F.col("m.train").eqNullSafe(F.col("k.train")) & F.col("m.number").eqNullSafe(F.col("k.number")) & F.col("m.print").eqNullSafe(F.col("k.print"))
    members = every.alias("m").join(kinds.alias("k"), same).select("m.article_row", "k.class")

    prints = kinds.filter("print IS NOT NULL").groupBy("train", "print").agg(F.min("class").alias("text_class"))
    texts = rows.join(prints.select(F.col("text_class").alias("article_row")), "article_row", "left_semi").select(F.col("article_row").alias("class"), "train", "ids")
    near = linked_classes(texts, rows.select(F.col("article_row").alias("class"), "ids"), least)
    by_print = kinds.filter("print IS NOT NULL").join(prints, ["train", "print"]).select("train", "class", "text_class", "print")
    left, right = by_print.filter("train").select(F.col("class").alias("t"), F.col("text_class").alias("train_class"), "print"), by_print.filter("NOT train").select(F.col("class").alias("o"), F.col("text_class").alias("other_class"), "print")
    numbered = kinds.filter("number IS NOT NULL").select("train", "class", "number")
    pairs = near.join(left.drop("print"), "train_class").join(right.drop("print"), "other_class").select("t", "o")
    pairs = pairs.unionByName(left.select("t", "print").join(right.select("o", "print"), "print").select("t", "o"))
    pairs = pairs.unionByName(numbered.filter("train").select(F.col("class").alias("t"), "number").join(numbered.filter("NOT train").select(F.col("class").alias("o"), "number"), "number").select("t", "o")).distinct()
    size = kinds.select("class", "members")
    pairs = pairs.join(size.select(F.col("class").alias("t"), F.col("members").alias("n_train")), "t").join(size.select(F.col("class").alias("o"), F.col("members").alias("n_other")), "o")
    return pairs.select(F.col("t").alias("train_class"), F.col("o").alias("other_class"), "n_train", "n_other"), members


def split_overlaps(articles: DataFrame, least: float = COVERAGE) -> DataFrame:
    """(article_lo, article_hi) of all rows of which exactly one is in ``train``, the same by number or by text. Members of large classes meet chunk by chunk."""
    links, members = linked_records(articles, least)
    links = cut(links)
    size = links.select(F.col("train_class").alias("class"), F.col("n_train").alias("n")).unionByName(links.select(F.col("other_class").alias("class"), F.col("n_other").alias("n"))).distinct()
    chunk = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    chunks = cut(members.join(size, "class").withColumn("part", F.pmod(F.xxhash64("article_row"), chunk("n")).cast("int")).groupBy("class", "part").agg(F.collect_list("article_row").alias("rows")))
    spread = links.withColumn("train_part", F.explode(F.sequence(F.lit(0), chunk("n_train") - 1))).withColumn("other_part", F.explode(F.sequence(F.lit(0), chunk("n_other") - 1)))
    side = lambda name: chunks.select(F.col("class").alias(f"{name}_class"), F.col("part").alias(f"{name}_part"), F.col("rows").alias(f"{name}_rows"))
    met = spread.join(side("train"), ["train_class", "train_part"]).join(side("other"), ["other_class", "other_part"])
    pairs = met.select(F.explode("train_rows").alias("t"), "other_rows").select("t", F.explode("other_rows").alias("o"))
    return pairs.select(F.least("t", "o").alias("article_lo"), F.greatest("t", "o").alias("article_hi"))


def overlap_report(articles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(split, source, n_articles, n_overlapping) of the evaluation splits."""
    hit = pairs.select(F.col("article_lo").alias("article_row")).unionByName(pairs.select(F.col("article_hi").alias("article_row"))).distinct().withColumn("hit", F.lit(1))
    held_out = articles.filter("split is null or split <> 'train'").select("article_row", "split", "source")
    return held_out.join(hit, "article_row", "left").groupBy("split", "source").agg(F.count("*").alias("n_articles"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_overlapping"))
