"""Byte-level BPE ids of every text, with a public vocabulary.

Texts are cut into words by the vocabulary's pattern; each distinct word of a task is encoded once. A short word is held
as contiguous arrays of part boundaries and adjacent ranks: the smallest rank is scanned for, its boundary deleted and the
two neighbouring ranks refreshed, until no pair is in the vocabulary. Words of more than ``SHORT`` bytes keep the same
ranks in a heap over linked parts, so that a text without spaces costs n log n.

Defined cases: null, empty texts have an empty list of ids; every row of the input gives one row. The vocabulary is a
parameter (a file of base64 tokens and ranks); it has a fixed size and is broadcast. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SHORT = 96
#: so many distinct words are remembered per task, of at most so many bytes
REMEMBERED = 300_000
REMEMBERED_BYTES = 64
_NONE = 1 << 30


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return _encode_long(word, ranks) if len(word) > SHORT else _encode_short(word, ranks)


def _encode_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    bounds = list(range(len(word) + 1))
    pair = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pair:
        low = min(pair)
        if low == _NONE:
            break
        i = pair.index(low)
        del bounds[i + 1], pair[i]
        if i < len(pair):
            pair[i] = ranks.get(word[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            pair[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    gone = bytearray(n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if gone[i] or after[i] >= n or after[after[i]] != end:
            continue
        j = after[i]
        gone[j] = 1
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (b := before[i]) >= 0 and (r := ranks.get(word[b:end])) is not None:
            heapq.heappush(heap, (r, b, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def encode_texts(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids): one row for every row of ``texts``; no shuffle."""
    shared = texts.sparkSession.sparkContext.broadcast(read_ranks(vocabulary or default_vocabulary()))
    cut = pattern or default_pattern()
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        ranks, words, known = shared.value, regex.compile(cut), {}
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for t in batch.column(1).to_pylist():
                for m in words.finditer(t or ""):
                    w = m[0]
                    ids = known.get(w)
                    if ids is None:
                        raw = w.encode()
                        ids = encode_word(raw, ranks)
                        if len(raw) <= REMEMBERED_BYTES:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[w] = ids
                    flat += ids
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")
