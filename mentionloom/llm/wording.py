"""The wording of a text, free of case, punctuation, markup, line breaks and typography, as comparable tokens."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import regex
import xxhash

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_SPLIT_WORD = regex.compile(r"(?<=\p{L})[-‐­]\s*\n[>\s]*(?=\p{Ll})")
_INVISIBLE = regex.compile(r"[\p{Cf}­]")
_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[^\W_\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+")
_ASCII_TOKEN = re.compile(r"[a-z0-9]+")
_SPACED_TOKEN = re.compile(r"[^\W_]+")
# Greek and Cyrillic letters; whatever is not of a European alphabet or plain punctuation
_LATIN, _OTHER, _FAR = re.compile("[a-z\u00df-\u024f\u1e00-\u1eff]"), re.compile("[\u0370-\u052f\u1c80-\u1c8f\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f]"), re.compile("[\u0590-\u1fff\u2c00-\U0010ffff]")
_MARKS = regex.compile(r"\p{Mn}+")
_MIXED = regex.compile(r"(?=[^\W\d_]*\p{Latin})(?=[^\W\d_]*[\p{Cyrillic}\p{Greek}])[^\W_]+")
# Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏԛԝвкмнтαοερνικτυ", "aeopcyxijsdhlqwbkmhtaoepviktu")


def tokens(text: str | None) -> list[str]:
    """Lower-case words; single characters in scripts that set no spaces. Words that mix look-alike letters are made Latin."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if "\n" in text:
        text = _SPLIT_WORD.sub("", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower()
        if _LATIN.search(text) and _OTHER.search(text):
            text = _MIXED.sub(lambda m: m[0].translate(_LOOKALIKES), text)
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
        return (_TOKEN if _FAR.search(text) else _SPACED_TOKEN).findall(text)
    return _ASCII_TOKEN.findall(text.lower())


class Hasher(dict):
    """64-bit ids of tokens, the same in every process; remembers up to ``most`` of them."""

    def __init__(self, most: int = 200_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word) - (1 << 63)
        return h

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n tokens; of the whole text where it is shorter."""
    n = min(n, len(ids))
    if n == 0:
        return np.empty(0, np.int64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ ids[k : len(ids) - n + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)
