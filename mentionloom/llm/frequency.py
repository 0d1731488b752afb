"""How often every distinct term occurs, and in how many records, from compressed bitmaps of record identifiers.

Vertical layout: each task turns its rows into one bitmap of occurrence ids and one of record ids per term - in containers
of 65,536 ids, sorted 16-bit arrays while sparse and plain bitmaps once dense - with counters beside them where an
occurrence holds a term more than once. A bitmap covers a bucket of 2^22 ids, so that a term of any frequency is spread
over as many shuffle keys as it has buckets. The bitmaps of a term and bucket are merged by union, which also removes
repeated deliveries, first those of a share of the tasks where they are large, then all; whatever their number, a key holds
one bitmap in memory. Both frequencies are read off the cardinalities.

Defined cases: null and empty terms are left out; a null occurrence id drops the row; a null record counts for no record;
records are compared as written (``PMC`` and a number is the number itself, anything else a 63-bit hash). An empty table
gives no terms. Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 22
DENSE = 4096
FLUSH_ROWS = 200_000
#: bitmaps from so many bytes on are united by that many shares of the tasks, and each by itself
HEAVY_BYTES, SHARES = 1 << 16, 256
RARE_RECORDS = 2
COMMON_SHARE = 0.05
_POSTINGS = "field string, term string, kind int, bucket bigint, bitmap binary, more binary"


def normal_text(text: str) -> str:
    """NFKC, lower case, white-space runs made one blank, ends trimmed."""
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


def pack(group: np.ndarray, low: np.ndarray, groups: int) -> pa.Array:
    """A bitmap for each group from 0 to ``groups``-1; (group, low) must be sorted and distinct, low below 2^22."""
    box = group.astype(np.int64) << 6 | low >> 16
    start = np.flatnonzero(np.concatenate(([True], box[1:] != box[:-1]))) if len(box) else np.empty(0, np.int64)
    card = np.diff(np.concatenate((start, [len(box)])))
    dense = card > DENSE
    words = 2 + np.where(dense, DENSE, card)
    at = np.concatenate(([0], np.cumsum(words)))
    out = np.zeros(at[-1], np.uint16)
    out[at[:-1]] = box[start] & 63
    out[at[:-1] + 1] = np.where(dense, 0, card)
    sparse = np.repeat(~dense, card)
    place = np.repeat(at[:-1] + 2 - start, card) + np.arange(len(box))
    out[place[sparse]] = (low & 0xFFFF)[sparse]
    for k in np.flatnonzero(dense):
        bits = np.zeros(65536, np.uint8)
        bits[low[start[k] : start[k] + card[k]] & 0xFFFF] = 1
        out[at[k] + 2 : at[k + 1]] = np.packbits(bits).view(np.uint16)
    per_group = np.bincount(box[start] >> 6, weights=words, minlength=groups).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(per_group) * 2)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), groups, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def unpack(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, low) of every set bit, all rows advancing together from container to container."""
    offsets = np.frombuffer(bitmaps.buffers()[1], np.int32, len(bitmaps) + 1, bitmaps.offset * 4).astype(np.int64)
    data = bitmaps.buffers()[2]
    words = np.frombuffer(data, np.uint16, int(offsets[-1]) // 2) if data is not None and offsets[-1] else np.empty(0, np.uint16)
    at, end = offsets[:-1] // 2, offsets[1:] // 2
    rows, lows = [], []
    live = np.flatnonzero(at < end)
    while len(live):
        p = at[live]
        key, card = words[p].astype(np.int64), words[p + 1].astype(np.int64)
        thin = card > 0
        n = card[thin]
        which = np.repeat(p[thin] + 2 - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        rows.append(np.repeat(live[thin], n))
        lows.append(np.repeat(key[thin] << 16, n) | words[which])
        for k in np.flatnonzero(~thin):
            bits = np.flatnonzero(np.unpackbits(words[p[k] + 2 : p[k] + 2 + DENSE].view(np.uint8)))
            rows.append(np.full(len(bits), live[k]))
            lows.append(key[k] << 16 | bits)
        at[live] = p + 2 + np.where(thin, card, DENSE)
        live = live[at[live] < end[live]]
    return (np.concatenate(rows), np.concatenate(lows)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def _postings(field: str, terms: pa.Array, code: np.ndarray, occurrence: np.ndarray, record: np.ndarray, recorded: np.ndarray):
    """One batch of bitmaps: kind 0 of occurrences, kind 1 of records."""
    for kind, ids, keep in ((0, occurrence, slice(None)), (1, record, recorded)):
        c, i = code[keep], ids[keep]
        order = np.lexsort((i, c))
        c, i = c[order], i[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (i[1:] != i[:-1]))) if len(c) else np.empty(0, bool)
        times = np.diff(np.concatenate((np.flatnonzero(new), [len(c)])))
        c, i = c[new], i[new]
        if not len(c):
            continue
        bucket = i >> BUCKET_BITS
        first = np.concatenate(([True], (c[1:] != c[:-1]) | (bucket[1:] != bucket[:-1])))
        group = np.cumsum(first) - 1
        n = int(group[-1]) + 1
        more = pa.nulls(n, pa.binary())
        if kind == 0 and (times > 1).any():
            extra: list[bytes | None] = [None] * n
            for g in np.unique(group[times > 1]):
                at = (group == g) & (times > 1)
                extra[g] = np.stack((i[at], times[at] - 1), 1).astype(np.int64).tobytes()
            more = pa.array(extra, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([field]).take(pa.array(np.zeros(n, np.int32))), terms.take(pa.array(c[first])), pa.array(np.full(n, kind, np.int32)), pa.array(bucket[first]), pack(group, i & ((1 << BUCKET_BITS) - 1), n), more],
            names=["field", "term", "kind", "bucket", "bitmap", "more"],
        )


def _once(occurrence: np.ndarray) -> np.ndarray:
    """The first row of each occurrence id, so that repeated deliveries in a task do not raise its counters."""
    return np.sort(np.unique(occurrence, return_index=True)[1])


def _collect(batches):
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= FLUSH_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _emit(batches):
    for t in _collect(batches):
        t = t.take(pa.array(_once(t.column(0).to_numpy())))
        occurrence = t.column(0).to_numpy()
        recorded = pc.is_valid(t.column(1)).to_numpy()
        record = pc.fill_null(t.column(1), 0).to_numpy()
        words = t.column(2).combine_chunks().dictionary_encode()
        normal = pa.array([normal_text(x) for x in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
        back = np.append(normal.indices.to_numpy(), -1)
        code = back[pc.fill_null(words.indices, len(words.dictionary)).to_numpy()]
        full = np.append(pc.greater(pc.utf8_length(normal.dictionary), 0).to_numpy(zero_copy_only=False), False)[code]
        yield from _postings("text", normal.dictionary, code[full], occurrence[full], record[full], recorded[full])
        parts = pc.split_pattern(pc.fill_null(t.column(3), ""), ";").combine_chunks()
        parent = pc.list_parent_indices(parts).to_numpy()
        ids = pc.utf8_trim_whitespace(pc.list_flatten(parts)).dictionary_encode()
        code = ids.indices.to_numpy()
        full = pc.greater(pc.utf8_length(ids.dictionary), 0).to_numpy(zero_copy_only=False)[code] if len(code) else np.empty(0, bool)
        code, parent = code[full], parent[full]
        yield from _postings("identifier", ids.dictionary, code, occurrence[parent], record[parent], recorded[parent])


def _keys(t: pa.Table) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    for name in ("field", "term", "kind", "bucket"):
        c = t.column(name)
        change[1:] |= pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)).to_numpy()
    return np.cumsum(change)


def _union_of(bitmaps: list[bytes]) -> tuple[bytes, int]:
    """(bitmap, cardinality) of the union of bitmaps of any size, in the space of one."""
    bits = np.zeros(1 << BUCKET_BITS - 4, np.uint16)
    for raw in bitmaps:
        words, at = np.frombuffer(raw, np.uint16), 0
        while at < len(words):
            box, card = int(words[at]) << 12, int(words[at + 1])
            if card:
                own = np.zeros(65536, np.uint8)
                own[words[at + 2 : at + 2 + card]] = 1
                bits[box : box + DENSE] |= np.packbits(own).view(np.uint16)
            else:
                bits[box : box + DENSE] |= words[at + 2 : at + 2 + DENSE]
            at += 2 + (card or DENSE)
    out, total = [], 0
    for box in range(1 << BUCKET_BITS - 16):
        part = bits[box * DENSE : (box + 1) * DENSE]
        if part.any():
            ids = np.flatnonzero(np.unpackbits(part.view(np.uint8)))
            total += len(ids)
            out += [np.array([box, 0 if len(ids) > DENSE else len(ids)], np.uint16), part if len(ids) > DENSE else ids.astype(np.uint16)]
    return np.concatenate(out).tobytes() if out else b"", total


def _united(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """One row for each key of ``t``, whose rows come sorted by key, and how many occurrences or records it counts."""
    t = t.combine_chunks()
    code = _keys(t)
    n = int(code[-1]) + 1
    bitmap, more = t.column("bitmap").combine_chunks(), t.column("more").combine_chunks()
    size = pc.binary_length(bitmap).to_numpy()
    large = np.bincount(code, size, minlength=n) >= HEAVY_BYTES
    thin = np.flatnonzero(~large[code])
    row, low = unpack(bitmap.take(pa.array(thin)))
    ids = np.unique(code[thin][row] << BUCKET_BITS | low)
    count = np.bincount(ids >> BUCKET_BITS, minlength=n)
    packed = pack(ids >> BUCKET_BITS, ids & ((1 << BUCKET_BITS) - 1), n)
    if large.any():
        every = packed.to_pylist()
        for k in np.flatnonzero(large):
            a, b = np.searchsorted(code, [k, k + 1])
            every[k], count[k] = _union_of(bitmap.slice(a, b - a).to_pylist())
        packed = pa.array(every, pa.binary())
    extra: list[bytes | None] = [None] * n
    if more.null_count < len(more):
        counters: dict[int, list[np.ndarray]] = {}
        for r in np.flatnonzero(pc.is_valid(more).to_numpy(zero_copy_only=False)):
            counters.setdefault(int(code[r]), []).append(np.frombuffer(more[int(r)].as_py(), np.int64).reshape(-1, 2))
        for k, found in counters.items():
            once = np.unique(np.concatenate(found), axis=0)
            extra[k], count[k] = once.tobytes(), count[k] + once[:, 1].sum()
    first = pa.array(np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))))
    keys = t.select(["field", "term", "kind", "bucket"]).take(first)
    return keys.append_column("bitmap", packed).append_column("more", pa.array(extra, pa.binary())), count


def _by_key(batches):
    """Tables of whole keys with their counts; of a key that goes on no more than one row is held."""
    held: list[pa.Table] = []
    rows = size = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 20_000):
            t = pa.Table.from_batches([batch.slice(start, 20_000)])
            held.append(t)
            rows, size = rows + t.num_rows, size + t.nbytes
            if rows < 50_000 and size < 8_000_000:
                continue
            t, count = _united(pa.concat_tables(held))
            if t.num_rows > 1:
                yield t.slice(0, t.num_rows - 1), count[:-1]
            held, rows, size = [t.slice(t.num_rows - 1).combine_chunks()], 1, 0
    if held and rows:
        yield _united(pa.concat_tables(held))


def _unite(batches):
    for t, _ in _by_key(batches):
        yield from t.combine_chunks().to_batches()


def _cardinality(batches):
    for t, count in _by_key(batches):
        kind = t.column("kind").to_numpy()
        yield pa.RecordBatch.from_arrays([t.column("field").combine_chunks(), t.column("term").combine_chunks(), pa.array(np.where(kind == 0, count, 0)), pa.array(np.where(kind == 1, count, 0))], names=["field", "term", "n_occ", "n_articles"])


def term_frequencies(rows: DataFrame, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """(field, term, n_occ, n_articles, mark) of the ``text`` and ``identifier`` of candidate_id and pmc_id rows."""
    number = F.regexp_extract("pmc_id", "^PMC([1-9][0-9]{0,17})$", 1)
    record = F.when(number != "", number.cast("bigint")).when(F.col("pmc_id").isNotNull(), F.xxhash64("pmc_id").bitwiseOR(F.lit(-(1 << 63))))
    postings = rows.filter("candidate_id is not null").select("candidate_id", record.alias("record"), "text", "identifier").mapInArrow(_emit, _POSTINGS)
    keys = ["field", "term", "kind", "bucket"]
    # large bitmaps of one key are united by shares of the tasks first, then all
    share = F.when(F.length("bitmap") >= HEAVY_BYTES, F.pmod(F.spark_partition_id(), F.lit(SHARES))).otherwise(-1)
    united = postings.withColumn("share", share).repartition(*keys, "share").sortWithinPartitions(*keys).select(*keys, "bitmap", "more").mapInArrow(_unite, _POSTINGS)
    merged = united.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_cardinality, "field string, term string, n_occ bigint, n_articles bigint")
    records = rows.agg(F.countDistinct("pmc_id")).first()[0]
    mark = F.when(F.col("n_articles") <= rare, "rare").when(F.col("n_articles") > common * records, "common").otherwise("kept")
    return merged.groupBy("field", "term").agg(F.sum("n_occ").alias("n_occ"), F.sum("n_articles").alias("n_articles")).withColumn("mark", mark)
