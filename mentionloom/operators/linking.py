"""Fuzzy linking of surfaces to ontology aliases by a similarity ratio: every pair that reaches the cutoff is found.

The ratio of two strings is twice their longest common subsequence over their summed length; the weighted ratio is the best of
the plain ratio, the ratio of the sorted words (0.95) and, for lengths that differ by half or more, the best window of the
longer one (0.9, or 0.6 from eightfold).

A cutoff implies a length of the common subsequence, and that so many letters are common; a character that isn't common breaks
at most one of the bigrams, so it also implies how many bigrams may be missing. Pairs are passed over by these two bounds alone, counted in
bits, and no pair that reaches the cutoff fails them.

Surfaces and aliases meet in groups of a share of either; a group returns the few best aliases of each surface. No pair of strings
leaves a task otherwise, and neither table goes to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mentionloom.session import cut, stored

#: characters of the aliases, and of the surfaces, of a group
BLOCK, PART = 4_000_000, 250_000
#: groups that are made of small tables, if a part has so many characters
GROUPS, LEAST_PART = 12, 10_000
#: characters in a word of bits
WORD = 64
#: words of bits of letters, and of bigrams, of a string; the last bigrams' word is shared by the rare ones
LETTERS, BIGRAMS = 2, 4
#: points that an alias of fewer than five characters loses
DOCKED = 8.0
_NEVER = 1 << 30


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & place.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    words = lambda s: " ".join(sorted(s.split()))
    best = max(ratio(a, b), 0.95 * ratio(words(a), words(b)))
    short, long = sorted((a, b), key=len)
    if len(long) >= 1.5 * len(short) and common_length(short, long) >= 0.8 * len(short):  # else no window can matter
        best = max(best, _window_ratio(short, long))
    return best


def _window_ratio(short: str, long: str) -> float:
    most, i = len(short) if short in long else 0, 0
    while most < len(short) and i <= len(long) - len(short):
        now = common_length(short, long[i : i + len(short)])
        most, i = max(most, now), i + max(most - now, 0) + 1  # a step adds one at most
    return (0.6 if len(long) >= 8 * len(short) else 0.9) * (200.0 * most / (2 * len(short)))


@F.pandas_udf(T.DoubleType())
def score(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(a, b) for a, b in zip(left, right, strict=True)])


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the text that each is of."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return flat, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _bits(bit: np.ndarray, owner: np.ndarray, words: int) -> np.ndarray:
    """The set of bits of each text, by words; ``bit`` in the order of texts, each of which has some, and those below 0 left out."""
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    one = np.uint64(1) << (bit & (WORD - 1)).astype(np.uint64)
    return np.stack([np.bitwise_or.reduceat(np.where((bit >= 0) & (bit // WORD == w), one, np.uint64(0)), first) for w in range(words)])


def _place(keys: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted vocabulary, or -1."""
    k = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
    return np.where(vocabulary[k] == keys, k, -1)


def _by_frequency(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in their order, and the rank of each by how often it occurs."""
    vocabulary, n = np.unique(keys, return_counts=True)
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
    return vocabulary, rank


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letter and its how manieth in the text as a number, text)."""
    flat, owner = _points(texts)
    key = np.sort(owner << 21 | flat)
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    nth = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
    return (key & (1 << 21) - 1) << 32 | nth, key >> 21


def _bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bigram as a number, text), with a blank on either side: the same for any order of the words."""
    flat, owner = _points([f" {t} " for t in texts])
    inside = owner[1:] == owner[:-1]
    return (flat[:-1] << 21 | flat[1:])[inside], owner[:-1][inside]


def _ordered(text: str) -> str:
    return " ".join(sorted(text.split()))


def _even(texts: list[str]) -> np.ndarray:
    """Whether words are parted by single blanks, so that sorting them changes neither letters nor bigrams; the others are compared with all."""
    return np.array([t == " ".join(t.split()) for t in texts], bool)


def _rows(texts: list[str], alphabet: np.ndarray, width: int = WORD) -> np.ndarray:
    """Characters of each text by place as numbers of the alphabet; beyond its end the number past the last."""
    out = np.full((len(texts), width), len(alphabet), np.uint8 if len(alphabet) < 256 else np.int32)
    flat, owner = _points([t[:width] for t in texts])
    start = np.cumsum(np.bincount(owner, minlength=len(texts))) - np.bincount(owner, minlength=len(texts))
    out[owner, np.arange(len(flat)) - start[owner]] = np.searchsorted(alphabet, flat)
    return out


def _common_lengths(a: str, rows: np.ndarray, alphabet: dict[str, int]) -> np.ndarray:
    """``common_length`` of one text with each of the texts of rows."""
    words = max(1, -(-len(a) // WORD))
    place = [[0] * (len(alphabet) + 1) for _ in range(words)]
    for i, c in enumerate(a):
        if (k := alphabet.get(c)) is not None:
            place[i // WORD][k] |= 1 << i % WORD
    columns = np.ascontiguousarray(rows.T)
    hits = [np.array(p, np.uint64)[columns] for p in place]
    row = [np.full(len(rows), ~np.uint64(0)) for _ in range(words)]
    more, less = np.empty_like(row[0]), np.empty_like(row[0])
    for i in range(len(columns)):
        over = None
        for w, x in enumerate(row):
            hit = hits[w][i]
            hit &= x
            np.add(x, hit, out=more)
            np.subtract(x, hit, out=less)
            if words > 1:
                if over is not None:
                    more += over
                over = (more < x) | ((more == x) & over if over is not None else False)
            np.bitwise_or(more, less, out=x)
    row[-1] |= ~np.uint64((1 << len(a) - WORD * (words - 1)) - 1)
    return WORD * words - sum(np.bitwise_count(x).astype(np.int64) for x in row)


class _Aliases:
    """An index of aliases: those that may reach the cutoff with a surface, and the best of them."""

    def __init__(self, aliases: list[str], cutoff: float) -> None:
        self.cutoff = cutoff
        length, even = np.array([len(t) for t in aliases]), _even(aliases)
        letter, owner = _letters(aliases)
        self.letter, rank = _by_frequency(letter)
        self.letter_bit = np.where(rank < LETTERS * WORD, rank, -1)
        letters = _bits(self.letter_bit[np.searchsorted(self.letter, letter)], owner, LETTERS)
        rest = length - np.bitwise_count(letters[0])
        order = np.lexsort((rest, length, even))  # those of a length together, so that what they need is found once
        self.texts, self.even, self.length, self.letters, self.rest = [aliases[i] for i in order.tolist()], even[order], length[order], np.ascontiguousarray(letters[:, order]), rest[order]
        change = (np.diff(self.even) != 0) | (np.diff(self.length) != 0) | (np.diff(self.rest) != 0)
        self.kind = np.flatnonzero(np.append(True, change))
        self.kinds, self.needed = np.diff(np.append(self.kind, len(aliases))), {}
        self.last_rest = self.rest - sum(np.bitwise_count(x) for x in self.letters[1:])
        bigram, owner = _bigrams(self.texts)
        self.bigram, rank = _by_frequency(bigram)
        own = (BIGRAMS - 1) * WORD
        self.bigram_bit = np.where(rank < own, rank, own + rank % WORD)
        self.bigrams = _bits(self.bigram_bit[np.searchsorted(self.bigram, bigram)], owner, BIGRAMS)
        alphabet = np.unique(np.append(_points(aliases)[0], 32))  # a blank joins the words
        self.points, self.alphabet = alphabet, {chr(c): k for k, c in enumerate(alphabet)}
        ordered = [_ordered(t) for t in self.texts]
        self.ordered_length = np.array([len(t) for t in ordered])
        self.rows, self.ordered_rows = _rows(self.texts, alphabet), _rows(ordered, alphabet)

    def profiles(self, surfaces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of surfaces: bits of letters and of bigrams, how many bigrams no alias has, and whether words are parted by single blanks."""
        letter, owner = _letters(surfaces)
        k = _place(letter, self.letter)
        letters = _bits(np.where(k >= 0, self.letter_bit[k], -1), owner, LETTERS)
        bigram, owner = _bigrams(surfaces)
        k = _place(bigram, self.bigram)
        bigrams = _bits(np.where(k >= 0, self.bigram_bit[k], -1), owner, BIGRAMS)
        return letters, bigrams, np.bincount(owner[k < 0], minlength=len(surfaces)), _even(surfaces)

    def _least(self, n: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common characters without which a surface of ``n`` and aliases of so many characters don't reach the cutoff, by the plain ratio or the sorted words, and by a window."""
        short, far = np.minimum(n, size), np.maximum(n, size)
        whole = np.ceil(self.cutoff * (n + size) / 200 - 1e-9).astype(np.int64)
        window = np.ceil(self.cutoff * short / np.where(far >= 8 * short, 60.0, 90.0) - 1e-9).astype(np.int64)
        return np.where(whole > short, _NEVER, whole), np.where((far < 1.5 * short) | (window > short), _NEVER, window)

    def reaching(self, n: int, letters: np.ndarray, bigrams: np.ndarray, unknown: int) -> tuple[np.ndarray, np.ndarray]:
        """Aliases that may reach the cutoff with a surface of ``n`` characters, and as many common letters as they have with it, or more."""
        rest = n - int(letters[0]).bit_count()
        if (n, rest) not in self.needed:
            need = np.minimum(*self._least(n, self.length[self.kind])) - np.minimum(rest, self.rest[self.kind])
            self.needed = {(n, rest): np.repeat(np.where(self.even[self.kind], need.clip(0, WORD + 1), 0).astype(np.uint8), self.kinds)}
        near = np.flatnonzero(np.bitwise_count(self.letters[0] & letters[0]) >= self.needed[n, rest])
        common = sum(np.bitwise_count(x[near] & y).astype(np.int64) for x, y in zip(self.letters, letters, strict=True))
        common += np.minimum(rest - sum(int(x).bit_count() for x in letters[1:]), self.last_rest[near])
        size, even = self.length[near], self.even[near]
        whole, window = self._least(n, size)
        keep = (common >= np.minimum(whole, window)) | ~even
        near, common, size, even, whole, window = (x[keep] for x in (near, common, size, even, whole, window))
        here, there = np.full(len(near), unknown), np.zeros(len(near), np.int64)  # bigrams of the surface that the alias lacks, and the other way round
        for x, y in zip(self.bigrams, bigrams, strict=True):
            x = x[near]
            here += np.bitwise_count(y & ~x)
            there += np.bitwise_count(x & ~y)
        spare = n + size - 3 * whole
        keep = (common >= whole) & (here <= n + spare) & (there <= size + spare)
        keep |= (common >= window) & (np.where(size < n, there, here) <= 3 * (np.minimum(n, size) - window) + 2)
        keep |= ~even
        return near[keep], np.where(even[keep], common[keep], np.minimum(n, size[keep]))

    def _common(self, a: str, near: np.ndarray, ordered: bool = False) -> np.ndarray:
        """``common_length`` of a text and the aliases ``near``, or their sorted words."""
        out, size = np.zeros(len(near), np.int64), self.length[near]
        order = np.argsort(size)
        small = np.searchsorted(size[order], WORD, "right")
        for i in range(0, small, 8192):
            now = order[i : min(i + 8192, small)]
            out[now] = _common_lengths(a, (self.ordered_rows if ordered else self.rows)[near[now], : size[now[-1]]], self.alphabet)
        for i in range(small, len(order), 256):
            now = order[i : i + 256]
            texts = [_ordered(self.texts[k]) if ordered else self.texts[k] for k in near[now].tolist()]
            out[now] = [common_length(a, t) for t in texts] if len(now) < 16 else _common_lengths(a, _rows(texts, self.points, size[now[-1]]), self.alphabet)
        return out

    def best(self, surface: str, near: np.ndarray, common: np.ndarray, most: int) -> list[tuple[float, str]]:
        """(score, alias) of the ``most`` best of the aliases ``near`` that reach the cutoff: the weighted ratio less what short aliases lose."""
        ordered = _ordered(surface)
        size = self.length[near]
        total, ordered_total = len(surface) + size, len(ordered) + self.ordered_length[near]
        short, far = np.minimum(len(surface), size), np.maximum(len(surface), size)
        factor = np.where(far >= 1.5 * short, np.where(far >= 8 * short, 60.0, 90.0), 0.0)
        off = np.where(size < 5, DOCKED, 0.0)
        off[[k for k in np.flatnonzero(off).tolist() if self.texts[near[k]] == surface]] = 0.0
        ordered_bound = np.where(ordered_total > 0, 190.0 * np.minimum(common, ordered_total / 2) / np.maximum(ordered_total, 1), 95.0) - off
        bound = np.maximum(np.maximum(200.0 * common / total - off, ordered_bound), factor * np.minimum(common / short, 1) - off)
        score, reach = np.full(len(near), -1.0), np.zeros(len(near))
        least, todo = self.cutoff - 1e-6, np.flatnonzero(bound >= self.cutoff - 1e-6)
        todo = todo[np.argsort(-bound[todo])]
        for first in (True, False):  # most of the best have the highest bounds; few of the others can then still reach them
            todo = todo[bound[todo] >= least]
            now, todo = (todo[: 8 * most], todo[8 * most :]) if first else (todo, todo[:0])
            if len(now):
                length = self._common(surface, near[now])
                score[now] = 200.0 * length / total[now] - off[now]
                reach[now] = np.where(length >= 0.8 * short[now], factor[now] * length / short[now] - off[now], 0.0)
                least = max(least, self._last(score, most))
                again = now[ordered_bound[now] >= least]
                if len(again):
                    same = self._common(ordered, near[again], ordered=True)
                    same = np.where(ordered_total[again] > 0, 200.0 * same / np.maximum(ordered_total[again], 1), 100.0)
                    score[again] = np.maximum(score[again], 0.95 * same - off[again])
                    least = max(least, self._last(score, most))
        wide = np.flatnonzero((reach >= least) & (reach > score))
        for i in wide[np.argsort(-reach[wide])]:
            if reach[i] >= least:
                score[i] = max(score[i], _window_ratio(*sorted((surface, self.texts[near[i]]), key=len)) - off[i])
                least = max(least, self._last(score, most))
        found = [(float(score[i]), self.texts[near[i]]) for i in np.flatnonzero(score >= least)]
        return sorted(((x, t) for x, t in found if x >= self.cutoff), key=lambda r: (-r[0], r[1]))[:most]

    @staticmethod
    def _last(score: np.ndarray, most: int) -> float:
        known = score[score > 0]
        return np.partition(known, -most)[-most] - 1e-6 if len(known) >= most else 0.0


def _meet(cutoff: float, most: int):
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        surfaces, out = left.column("surface").to_pylist(), []
        if surfaces and right.num_rows:
            index = _Aliases(right.column("alias").to_pylist(), cutoff)
            letters, bigrams, unknown, even = index.profiles(surfaces)
            length = np.array([len(t) for t in surfaces])
            for k in np.lexsort((np.bitwise_count(letters[0]), length)).tolist():
                n = len(surfaces[k])
                near, common = index.reaching(n, letters[:, k], bigrams[:, k], unknown[k]) if even[k] else (np.arange(len(index.texts)), np.minimum(n, index.length))
                out += [(surfaces[k], t, x) for x, t in index.best(surfaces[k], near, common, most)]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["surface", "alias", "score"])

    return meet


def _characters(rows: DataFrame, column: str) -> int:
    return rows.agg(F.sum(F.length(column))).first()[0] or 0


def _candidates(surfaces: DataFrame, aliases: DataFrame, cutoff: float, most: int, block: int, part: int) -> DataFrame:
    """(surface, alias, score): of each surface the best aliases in each block of aliases."""
    size = _characters(surfaces, "surface")
    blocks = max(1, -(-_characters(aliases, "alias") // block))
    parts = max(1, -(-size // part), min(-(-size // min(part, LEAST_PART)), GROUPS // blocks))
    share = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = surfaces.select("surface", share("surface", parts).alias("part"), every(blocks).alias("block"))
    right = aliases.select("alias", every(parts).alias("part"), share("alias", blocks).alias("block"))
    left, right = (x.repartition(blocks * parts, "part", "block").groupBy("part", "block") for x in (left, right))  # a number, else small shares are put together again
    return left.cogroup(right).applyInArrow(_meet(cutoff, most), "surface string, alias string, score double")


def fuzzy_scores(surfaces: DataFrame, aliases: DataFrame, cutoff: float = 78.0, most: int = 5, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(surface, alias, score): of each surface the ``most`` best of all aliases that reach the cutoff after those of fewer than five characters lost 8 points; an exact alias scores 100."""
    left = cut(surfaces.select("surface").filter("surface <> ''").distinct())
    right = cut(aliases.select("alias").filter("alias <> ''").distinct())
    near = cut(_candidates(left, right, cutoff, most, block, part))
    top = near.withColumn("_r", F.row_number().over(Window.partitionBy("surface").orderBy(F.desc("score"), "alias")))
    return top.filter(F.col("_r") <= most).drop("_r")


def fuzzy_link(surfaces: DataFrame, alias_ids: DataFrame, cutoff: float = 78.0) -> DataFrame:
    """(surface, alias, identifier, score): the exact alias, or the best of all aliases that reach the cutoff with what short ones lose."""
    right = cut(alias_ids.select("alias", "identifier"))
    said = cut(surfaces.select("surface").filter("surface <> ''").distinct())
    named = right.withColumn("surface", F.col("alias"))
    exact = said.join(named, "surface").select("surface", "alias", "identifier", F.lit(100.0).alias("score")).filter(F.col("score") >= cutoff)
    best = fuzzy_scores(said.join(named, "surface", "left_anti"), right, cutoff, most=1)
    return exact.unionByName(best.join(right, "alias").select("surface", "alias", "identifier", "score"))


def link(mentions: DataFrame, alias_ids: DataFrame, cutoff: float = 78.0) -> DataFrame:
    """(link_id, alias, identifier, score, exact) of groups of wordings (link_id, ord, surface): the first exact alias in their order, else the best fuzzy one of any of them, earlier wordings first."""
    right = cut(alias_ids.select("alias", "identifier"))
    said = mentions.select("link_id", "ord", "surface").filter("surface <> ''")
    exact = said.join(right.withColumnRenamed("alias", "surface"), "surface").groupBy("link_id").agg(F.min(F.struct("ord", F.col("surface").alias("alias"), "identifier")).alias("b")).select("link_id", "b.alias", "b.identifier", F.lit(100.0).alias("score"), F.lit(True).alias("exact"))
    rest = said.join(exact, "link_id", "left_anti")
    scored = rest.join(fuzzy_scores(rest, right, cutoff, most=1), "surface")
    best = scored.groupBy("link_id").agg(F.min(F.struct((-F.col("score")).alias("col1"), "ord", "alias")).alias("b")).select("link_id", "b.alias", (-F.col("b.col1")).alias("score"))
    return exact.unionByName(best.join(right, "alias").select("link_id", "alias", "identifier", "score", F.lit(False).alias("exact")))


def few_shot_identifiers(findings: DataFrame, alias_ids: DataFrame, cutoff: float = 92.0) -> DataFrame:
    """(finding_id, identifier) of (finding_id, text, canonical): the exact alias of the text, else a link of text and canonical name; an identifier that a model gave is not looked at."""
    said = findings.select(F.col("finding_id").alias("link_id"), F.posexplode(F.array("text", "canonical")).alias("ord", "surface")).filter("surface is not null")
    return link(said, alias_ids, cutoff).select(F.col("link_id").alias("finding_id"), "identifier")


def finding_identifiers(findings: DataFrame, alias_rows: DataFrame, resolved: DataFrame, majority: DataFrame, supplied_cutoff: float = 72.0, fuzzy_cutoff: float = 88.0) -> DataFrame:
    """``findings`` (finding_id, text, canonical, supplied; text and canonical normalised) with ``identifier`` and ``how``.

    A supplied id counts if one of its aliases is like the text or the canonical name; else the majority id or exact alias of
    the text, then of the canonical name; else the best fuzzy link of either. ``alias_rows`` is (alias, identifier),
    ``resolved`` one identifier per alias, ``majority`` (surface, identifier).
    """
    cols = ["text", "canonical", "supplied"]
    findings = stored(findings, "findings")  # read twice
    values = stored(findings.select(cols).distinct().withColumn("_key", F.monotonically_increasing_id()), "values")  # each value once: the ratio is the costly part
    said = values.select("_key", "supplied", F.posexplode(F.array("text", "canonical")).alias("i", "surface")).filter("surface <> ''")
    known = said.filter("supplied is not null").join(alias_rows.withColumnRenamed("identifier", "supplied"), "supplied")
    a = known.filter(score("surface", "alias") >= supplied_cutoff).groupBy("_key").agg(F.first("supplied").alias("by_id"))
    exact = said.join(majority.select("surface", F.col("identifier").alias("usual")), "surface", "left").join(resolved.select(F.col("alias").alias("surface"), F.col("identifier").alias("named")), "surface", "left")
    b = exact.filter("coalesce(usual, named) is not null").groupBy("_key").agg(F.min_by(F.coalesce("usual", "named"), "i").alias("by_name"))
    sure = stored(values.join(a, "_key", "left").join(b, "_key", "left"), "sure")
    rest = sure.filter("coalesce(by_id, by_name) is null").select("_key", F.explode(F.array("text", "canonical")).alias("surface")).filter("surface <> ''")
    near = fuzzy_link(rest.select("surface"), resolved, fuzzy_cutoff)
    c = rest.join(near.select("surface", F.col("identifier").alias("linked"), "score"), "surface").groupBy("_key").agg(F.max_by("linked", F.struct("score", F.col("linked"))).alias("by_likeness"))
    how = F.when(F.col("by_id").isNotNull(), "supplied").when(F.col("by_name").isNotNull(), "exact").when(F.col("by_likeness").isNotNull(), "fuzzy")
    given = sure.join(c, "_key", "left").select(*[F.col(x).alias(f"_{x}") for x in cols], F.coalesce("by_id", "by_name", "by_likeness").alias("identifier"), how.alias("how"))
    same = [findings[x].eqNullSafe(given[f"_{x}"]) for x in cols]
    return findings.join(given.filter("identifier is not null"), same, "left").select(*findings.columns, "identifier", "how")
