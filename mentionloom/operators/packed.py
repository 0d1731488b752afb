"""Several values packed in one field, split to one row per value with its position.

Each Arrow batch is scanned as bytes: masks of quotes, brackets and delimiters are built over the whole string buffer,
quote parity and bracket depth come from running sums, and the delimiters outside both give the child offsets of a list
array. Only the trimming of the pieces works on the pieces.

Defined cases: a null, blank or delimiter-only field has no values; unpaired quotes or brackets count as plain
characters; a key that comes several times counts once (the smallest list of values, where they differ); rows with a
null key count as one key. Extra columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What may stand between two values, as UTF-8 bytes of length 1 and 3.
DELIMITERS = (";", ",", "|", "/", "+", "\t", "\n", "\r")
WIDE_DELIMITERS = ("；", "，", "、", "｜", "／")
#: a space only parts two ids
ID_PATTERN = r"(?:HP[:_]\d+|-1)"


def _per_row(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running count of mask before each byte, and the count of each row."""
    run = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return run, run[ends] - run[starts]


def split_packed(column: pa.Array) -> pa.ListArray:
    """The values of each field; the scan is vectorised over the whole buffer."""
    column = column.cast(pa.large_string()).fill_null("")
    # a space between two ids parts them; so does the comma of a JSON array, whose brackets are dropped
    column = pc.replace_substring_regex(column, r"^\s*\[(.*)\]\s*$", r"\1")
    if pc.any(pc.match_substring_regex(column, rf"{ID_PATTERN}\)? +{ID_PATTERN}")).as_py():
        for _ in range(2):  # twice, as matches share their middle id
            column = pc.replace_substring_regex(column, rf"(^|[^A-Za-z0-9:])({ID_PATTERN}) +({ID_PATTERN})", "\\1\\2\t\\3")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    base, total = int(offsets[0]), int(offsets[-1] - offsets[0])
    starts, ends = offsets[:-1] - base, offsets[1:] - base
    data = np.frombuffer(column.buffers()[2], np.uint8, total, base) if total else np.empty(0, np.uint8)
    row_of = np.repeat(np.arange(n), ends - starts)

    plain = np.zeros(total, bool)
    for d in DELIMITERS:
        plain |= data == ord(d)
    wide = np.zeros(total, bool)
    for d in WIDE_DELIMITERS:
        a, b, c = d.encode()
        if total > 2:
            wide[:-2] |= (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
    # single quotes count where they open or close a piece: beside a delimiter or an end of the row
    blank = (data == 32) | (data == 9)
    edge_after = np.ones(total, bool)
    edge_before = np.ones(total, bool)
    if total:
        limit = plain | wide
        nxt = np.concatenate((limit[1:], [True]))
        prv = np.concatenate(([True], limit[:-1]))
        first, last = np.zeros(total, bool), np.zeros(total, bool)
        filled = ends > starts
        first[starts[filled]], last[ends[filled] - 1] = True, True
        wide_end = np.concatenate(([False] * min(3, total), wide[:-3]))[:total]
        edge_after, edge_before = nxt | last, prv | first | wide_end
        edge_after |= np.concatenate((blank[1:], [False])) & np.concatenate((nxt[1:], [True]))
        edge_before |= np.concatenate(([False], blank[:-1])) & np.concatenate(([True], prv[:-1]))
    double = data == ord('"')
    single = (data == ord("'")) & (edge_after | edge_before)
    quoted = np.zeros(total, bool)
    for q in (double, single):
        run, count = _per_row(q, starts, ends)
        paired = (count % 2 == 0)[row_of]
        quoted |= paired & ((run[:-1] - run[starts][row_of] + q) % 2 == 1)
    opened, closed = (data == ord("(")) & ~quoted, (data == ord(")")) & ~quoted
    run_o, count_o = _per_row(opened, starts, ends)
    run_c, count_c = _per_row(closed, starts, ends)
    depth = (run_o[:-1] - run_o[starts][row_of] + opened) - (run_c[:-1] - run_c[starts][row_of])
    inside = (count_o == count_c)[row_of] & (depth > 0)
    free = ~quoted & ~inside
    cuts = np.flatnonzero((plain | wide) & free)
    width = np.where(wide[cuts], 3, 1)

    # pieces: from the row's start or the end of a cut to the next cut or the row's end
    piece_row = np.concatenate((np.arange(n), row_of[cuts]))
    piece_start = np.concatenate((starts, cuts + width))
    order = np.lexsort((piece_start, piece_row))
    piece_row, piece_start = piece_row[order], piece_start[order]
    piece_end = np.concatenate((cuts, ends))
    piece_end = piece_end[np.lexsort((piece_end, np.concatenate((row_of[cuts], np.arange(n)))))]
    # the bytes between the pieces are dropped from the child buffer
    size = piece_end - piece_start
    child_offsets = np.concatenate(([0], np.cumsum(size)))
    keep = np.repeat(piece_start - child_offsets[:-1], size) + np.arange(child_offsets[-1])
    child = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(child_offsets.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes() if total else b"")])
    child = pc.utf8_trim_whitespace(child)
    for q in ('"', "'"):
        enclosed = pc.and_(pc.and_(pc.starts_with(child, q), pc.ends_with(child, q)), pc.greater(pc.utf8_length(child), 1))
        if pc.any(enclosed).as_py():
            bare = pc.replace_substring(pc.utf8_slice_codeunits(child, 1, -1), q + q, q)
            child = pc.if_else(enclosed, pc.utf8_trim_whitespace(bare), child)
    full = pc.greater(pc.utf8_length(child), 0)
    mask = full.to_numpy(zero_copy_only=False)
    counts = np.bincount(piece_row[mask], minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), child.filter(full).cast(pa.string()))


def split_values(rows: DataFrame, key: str = "entity_id", packed: str = "identifier", least: int = 2) -> DataFrame:
    """(key, pos, val) of every field with at least ``least`` values. One shuffle, of the packed fields alone."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            values = split_packed(batch.column(1))
            enough = pc.greater_equal(pc.list_value_length(values), least)
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[key, "vals"]).filter(enough)

    lists = rows.select(F.col(key), F.col(packed).cast("string").alias("packed")).mapInArrow(run, f"{key} {kind}, vals array<string>")
    once = lists.groupBy(key).agg(F.min("vals").alias("vals"))
    return once.select(key, F.posexplode("vals").alias("pos", "val"))
