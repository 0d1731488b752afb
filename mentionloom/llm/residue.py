"""Template residue, filler, error pages and script notices that stand in place of content.

Everything is learned from what the records have in common; two passes read the documents.

The first pass aligns. Units (lines and their sentences) with template markers are aligned by their skeleton, the unit with its
markers taken out: a slot is induced where records of one skeleton hold different fillers in it, some in an unmistakable
marker, and the fillers of induced slots that recur are variable names. Pages are aligned by their pairs of neighbouring
words, numbers being slots: a pair that stands mostly in bare pages (a few lines and no more), in several of them with
different texts, belongs to a repeated template of whole pages: an error, a notice, a prompt. Filler is aligned by its words:
those that keep company with the two words that everybody's nonsense Latin begins with.

The second pass flags a document if a slot retains a variable name, a default or a blank; if a unit is made of pairs of
repeated page templates, alone or in content that was cut off for it; if a unit is nonsense filler or the same words over and
over; or if a line has the public form of an HTTP status, a JSON error body or a whole page of one recurring short line.

Defined cases: null, empty and blank texts are no cases; a document that comes several times gives one row; markers in
quotation marks are mentions, no residue; a marker that no other record bears out is none either. What is learned is joined
as a table or, where it is a set of numbers, sent to the tasks in blocks of at most ``BLOCK``: a larger set takes more
passes and gives the same rows. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionloom.session import cut

#: pages of at most so many UTF-8 bytes teach what whole-page templates say; pages of any size are searched for it
BARE_BYTES = 300
#: a pair of words is a template's if so many bare pages hold it, with different texts, and at least this share of all that hold it are bare
LEAST_PAGES, BARE_SHARE = 3, 0.5
#: a unit is a template's from this share of its pairs and so many pairs
TEMPLATE_SHARE, LEAST_PAIRS = 0.6, 2
#: a single short line is a template if so many pages are nothing else, and this share of all documents that have the line
LEAST_SAME, SAME_SHARE = 5, 0.8
#: share of a unit's words that are filler; a word is filler if it stands in nonsense Latin so often
FILLER_SHARE, FILLER_WORDS, FILLER_COMPANY = 0.7, 2, 0.25
#: a filler names a variable if it fills slots of so many templates
LEAST_TEMPLATES = 2
#: numbers of a learned set that go to the tasks at once (8 bytes each)
BLOCK = 2_000_000

# The forms of markers. Plain forms also occur in ordinary text and need a learned name.
_NAME = r"[^\W\d_][\w.\- ]{1,40}?"
STRONG_MARKERS = {
    "braces": rf"\{{\{{\s*({_NAME})\s*\}}\}}",
    "dollar": rf"\$\{{\s*({_NAME})\s*\}}",
    "erb": rf"<%=?\s*({_NAME})\s*%>",
    "at": rf"@@\s*({_NAME})\s*@@",
    "brackets": rf"\[\[\s*({_NAME})\s*\]\]",
    "angles": rf"<<\s*({_NAME})\s*>>",
    "here": rf"<({_NAME})_HERE>",
    "insert": rf"\[INSERT ({_NAME})\]",
    "added": rf"\[({_NAME}) to be added\]",
    "blank": r"_{4,}\s*\(([A-Za-z][\w.\- ]{1,40})\)",
    "fill": r"[\[（]\s*((?:à|bitte|por favor|please|to be|待|要|未)?\s*(?:compl[ée]ter|completar|rellenar|ergänzen|ausfüllen|einfügen|заполнить|указать|вставить|填写|补充|填|記入|入力|fill in|fill out|filled in|completed)[^\]）]{0,20})\s*[\]）]",
    "default": r"\b(XXXX-XX-XX|DD-MM-YYYY|YYYY-MM-DD|XXX+)\b",
}
PLAIN_MARKERS = {"tag": rf"<({_NAME})>", "brace": rf"\{{({_NAME})\}}", "percent": rf"%({_NAME})%", "bracket": rf"\[({_NAME})\]", "line": r"(_{4,})"}
_FORMS = {**STRONG_MARKERS, **PLAIN_MARKERS}
_MARKER = re.compile(r"(?=[{$<@\[（_%XDY])(?:" + "|".join(f"(?P<{style}>{pattern})" for style, pattern in _FORMS.items()) + ")")
_MARKED = re.compile(r"[{\[（]|<[%<\w]|@@|____|%[^\W\d_]|XXX|-MM-")
_QUOTES = "\"'“”„«»‘’「」‹›`"

# Public forms of an HTTP status line with its reason phrase and of a JSON error body.
_REASONS = "bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway timeout"
_STATUS = regex.compile(
    rf"^[>\s]*(?:(?:<\w+>)*(?:http[ /]?[\d.]* ?)?(?:error |status:? ?)?[45]\d\d(?:</?\w+>)*\s*[-–—:(]*\s*(?:{_REASONS})\)?(?:</?\w+>)*\.?|http error [45]\d\d\s*:.*|\{{\s*\"error\"\s*:.*\}})\s*$",
    regex.IGNORECASE | regex.MULTILINE,
)
# The words that nonsense Latin is known by.
_NONSENSE = ("lorem", "ipsum")
_LETTER_RUNS = re.compile(r"^[>\s]*([a-z])\1{2,}(?: ([a-z])\2{2,})+\W*$", re.I | re.M)
_SENTENCE = regex.compile(r"(?<=[.!?]['\"”’»)\]]?)\s+|(?<=[。！？।])")
# scripts that set no spaces: Thai, kana, Han
_UNSPACED = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
# line ends and sentence ends stand between the words
_PIECE = re.compile(rf"[^\W_{_UNSPACED}]+|[{_UNSPACED}]|\n|[.!?]['\"”’»)\]]?(?=\s)|[。！？।]")
_LINE, _STOP, _NUMBER = 0, 1, 2


def units(text: str) -> list[str]:
    """Lines, and the sentences of each; quoting marks of mail are dropped."""
    out = []
    for line in text.split("\n"):
        line = line.strip().lstrip(">").strip()
        if line:
            out.append(line)
            parts = [p.strip() for p in _SENTENCE.split(line) if p and p.strip()]
            if len(parts) > 1:
                out.extend(parts)
    return out


def name_of(filler: str) -> str:
    return re.sub(r"[\W_]", "", filler.lower())


def markers(unit: str) -> list[tuple[str, str, int, int]]:
    """(style, name, start, end) of the markers of a unit that don't stand in quotation marks."""
    found = []
    for m in _MARKER.finditer(unit):
        style = next(k for k in _FORMS if m[k] is not None)
        before, after = unit[: m.start()].rstrip()[-1:], unit[m.end() :].lstrip()[:1]
        if before and after and before in _QUOTES and after in _QUOTES:
            continue
        inner = m[_MARKER.groupindex[style] + 1]
        found.append((style, name_of(inner), m.start(), m.end()))
    return found


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _slots(text: str) -> list[tuple[int, int, str, str]]:
    """(template, slot, style, name) of every marker: the template is the unit without its markers and numbers."""
    out = []
    if _MARKED.search(text):
        for line in text.split("\n"):
            for unit in units(line) if _MARKED.search(line) else ():
                found = markers(unit) if _MARKED.search(unit) else ()
                parts, at = [], 0
                for _, _, a, b in found:
                    parts += [unit[at:a], "\0"]
                    at = b
                template = _hash(re.sub(r"\d+", "0", "".join([*parts, unit[at:]]))) if found else 0
                out += [(template, i, style, name) for i, (style, name, _, _) in enumerate(found)]
    return out


def _outline(text: str) -> int:
    return _hash(re.sub(r"\d+", "0", text.strip().lower()))


class _Numbers(dict):
    """64-bit numbers of pieces, the same in every process."""

    def __missing__(self, piece: str) -> int:
        number = _LINE if piece == "\n" else _STOP if piece[0] in ".!?。！？।" else _NUMBER if any(map(str.isdigit, piece)) else xxhash.xxh64_intdigest(piece) - (1 << 63)
        self[piece] = number
        return number


class _Pieces:
    """The words of a batch of texts as numbers, with the line and the sentence that each stands in, and their neighbourly pairs."""

    def __init__(self, texts: list[str], known: _Numbers) -> None:
        if len(known) > 300_000:
            known.clear()
        all_ = np.fromiter(map(known.__getitem__, _PIECE.findall("\n".join([*texts, ""]).lower())), np.int64)
        lines = np.cumsum(all_ == _LINE)
        ends = np.cumsum([t.lower().count("\n") + 1 for t in texts])
        owner = np.searchsorted(ends, lines - (all_ == _LINE), side="right")
        word = all_ > _STOP
        word |= all_ < _LINE
        self.owner = owner[word]
        self.line = lines[word]
        self.sentence = (np.cumsum(~word))[word]
        self.word = all_[word]
        if len(self.word):
            mixed = self.word[:-1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ self.word[1:].view(np.uint64)
            self.pair = ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
        else:
            self.pair = np.empty(0, np.int64)
        self.in_line = self.line[:-1] == self.line[1:]


def _portions(batches, most: int = 4_000_000):
    """Batches cut where their texts (the last column) pass so many characters; a longer text stands alone."""
    for batch in batches:
        ends, total = [0], 0
        for i, n in enumerate(pc.utf8_length(batch.column(batch.num_columns - 1)).to_pylist()):
            if total and total + n > most:
                ends.append(i)
                total = 0
            total += n
        for a, b in zip(ends, [*ends[1:], batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def _per_key(key: np.ndarray, owner: np.ndarray, prints: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, documents, chosen documents, least and greatest print of the chosen): each document counts once for a key."""
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    if not len(key):
        return (key,) * 5
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    hit = chosen[owner]
    top, low = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    return key[start], np.diff(np.append(start, len(key))), np.add.reduceat(hit.astype(np.int64), start), np.minimum.reduceat(np.where(hit, prints[owner], top), start), np.maximum.reduceat(np.where(hit, prints[owner], low), start)


_EVIDENCE = "kind string, key bigint, slot int, name string, n bigint, m bigint, lo bigint, hi bigint"


def _counts(kind: str, key, n, m, lo=None, hi=None, slot=None, name=None) -> pa.RecordBatch:
    size = len(key)
    column = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * size, pa.string()), pa.array(key, pa.int64()), column(slot, pa.int32()), column(name, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), column(lo, pa.int64()), column(hi, pa.int64())],
        names=["kind", "key", "slot", "name", "n", "m", "lo", "hi"],
    )


def _evidence(batches):
    """Counts of each batch: documents by pair, word, short line and slot filler."""
    known = _Numbers()
    nonsense = [xxhash.xxh64_intdigest(w) - (1 << 63) for w in _NONSENSE]
    for batch in _portions(batches):
        texts = batch.column(0).to_pylist()
        p = _Pieces(texts, known)
        prints = np.array([_hash(t) for t in texts], np.int64)
        bare = np.array([len(t) <= BARE_BYTES and len(t.encode()) <= BARE_BYTES for t in texts], bool)
        inside = p.in_line
        yield _counts("pair", *_per_key(p.pair[inside], p.owner[:-1][inside], prints, bare))
        silly = np.logical_and.reduce([np.bincount(p.owner[p.word == w], minlength=len(texts)) > 0 for w in nonsense])
        if silly.any():
            yield _counts("silly", *_per_key(p.word[silly[p.owner]], p.owner[silly[p.owner]], prints, silly))
        yield _counts("word", *_per_key(p.word, p.owner, prints, silly))
        short = np.bincount(p.line, minlength=1)
        lines: dict[int, list[int]] = {}
        number = 0
        for text in texts:
            rows = text.split("\n")
            for k, row in enumerate(rows):
                if number + k < len(short) and 0 < short[number + k] <= 2:
                    v = lines.setdefault(_outline(row), [0, 0])
                    v[0] += 1
                    v[1] += row.strip() == text.strip()
            number += len(rows)
        if lines:
            yield _counts("line", list(lines), [v[0] for v in lines.values()], [v[1] for v in lines.values()])
        slots: dict[tuple, int] = {}
        for text in texts:
            for template, i, style, name in _slots(text):
                k = (template, i, f"{style}\t{name}")
                slots[k] = slots.get(k, 0) + 1
        if slots:
            key, slot, name = zip(*slots, strict=True)
            yield _counts("slot", key, list(slots.values()), [0] * len(slots), slot=slot, name=name)


def evidence(documents: DataFrame) -> DataFrame:
    """What is learned from all documents, as a written table: pairs and short lines of page templates, filler words, fillers by slot."""
    seen = documents.filter("trim(text) <> ''").select("text").mapInArrow(_evidence, _EVIDENCE)
    counts = seen.groupBy("kind", "key", "slot", "name").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    kept = f"kind = 'slot' OR kind = 'pair' AND m >= {LEAST_PAGES} AND m >= {BARE_SHARE} * n AND lo <> hi OR kind = 'word' AND m >= {FILLER_WORDS} AND m >= {FILLER_COMPANY} * n OR kind = 'line' AND m >= {LEAST_SAME} AND m >= {SAME_SHARE} * n"
    return cut(counts.filter(kept))


def induced(counts: DataFrame) -> DataFrame:
    """(key, slot) where records of one template hold different fillers, some in an unmistakable marker."""
    strong = F.split("name", "\t")[0].isin(*STRONG_MARKERS)
    return counts.filter("kind = 'slot'").groupBy("key", "slot").agg(F.countDistinct(F.split("name", "\t")[1]).alias("k"), F.max(strong).alias("strong")).filter("k >= 2 AND strong").select("key", "slot")


def variable_names(counts: DataFrame) -> DataFrame:
    """(name) of the fillers that stand in induced slots of several templates."""
    fillers = counts.filter("kind = 'slot'").withColumn("name", F.split("name", "\t")[1])
    return fillers.join(induced(counts), ["key", "slot"]).filter("name <> ''").groupBy("name").agg(F.countDistinct("key").alias("templates")).filter(F.col("templates") >= LEAST_TEMPLATES).select("name")


def _held(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _same_over_and_over(p: _Pieces, unit: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Units without numbers that are one to eight words again and again, at least three times; the last word may be cut off."""
    letters = np.bincount(unit, p.word == _NUMBER, minlength=len(size)) == 0
    found = np.zeros(len(size), bool)
    for lag in range(1, 9):
        if len(p.word) > lag:
            same = (p.word[lag:] == p.word[:-lag]) & (unit[lag:] == unit[:-lag])
            n = np.bincount(unit[lag:][same], minlength=len(size))
            found |= (size >= 3 * lag) & (size >= 3) & (n == size - lag) | (size >= 4 * lag) & (size >= 4) & (n == size - lag - 1) & (lag < 3)
    return found & letters


_TRACE = "doc_id bigint, kind string, key bigint, slot int, name string, unit bigint, n int, hits int"


def _traces(batches, pairs: np.ndarray, words: np.ndarray, blocks: int, first: bool):
    """Rows of what is residue, or would be if the tables joined later bear it out. Of several blocks every hit counts, since only all together say whether a unit has its share.

    A unit is numbered within its text, and the text by its print, so that the passes agree however the rows are dealt."""
    known = _Numbers()
    enough = lambda hits, n, share: (hits > 0) & ((hits >= share * n) | (blocks > 1))
    for batch in _portions(batches):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows: list[tuple] = []
        p = _Pieces(texts, known)
        prints: dict[int, int] = {}

        def found(kind, name, u, n, hits, of, begin, ids=ids, texts=texts, prints=prints, rows=rows):
            d = int(of[u])
            if d not in prints:
                prints[d] = _hash(texts[d])
            rows.append((ids[d], kind, prints[d], None, name, int(u - begin[d]), int(n[u]), int(hits[u])))

        in_pairs, in_words = _held(p.pair, pairs), _held(p.word, words)
        for name, unit in (("line", p.line), ("sentence", p.sentence)):
            top = int(unit[-1]) + 1 if len(unit) else 0
            size = np.bincount(unit, minlength=top)
            of = np.zeros(top, np.int64)
            of[unit] = p.owner
            begin = np.zeros(len(texts), np.int64)
            begin[p.owner[::-1]] = unit[::-1]
            inside = unit[:-1] == unit[1:]
            n = np.bincount(unit[:-1][inside], minlength=top)
            hits = np.bincount(unit[:-1][inside & in_pairs], minlength=top)
            for u in np.flatnonzero((n >= LEAST_PAIRS) & enough(hits, n, TEMPLATE_SHARE)):
                found("pair", name, u, n, hits, of, begin)
            hits = np.bincount(unit[in_words], minlength=top)
            for u in np.flatnonzero(((size >= 4) | (size == 2)) & enough(hits, size, FILLER_SHARE)):
                found("word", name, u, size, hits, of, begin)
            if first and name == "sentence":
                for u in np.flatnonzero(_same_over_and_over(p, unit, size)):
                    rows.append((ids[of[u]], "sure", None, None, None, None, None, None))
        if first:
            total = np.bincount(p.owner, minlength=len(texts))
            for i, text, n in zip(ids, texts, total, strict=True):
                if _STATUS.search(text) or _LETTER_RUNS.search(text):
                    rows.append((i, "sure", None, None, None, None, None, None))
                if 0 < n <= 2:
                    rows.append((i, "line", _outline(text), None, None, None, None, None))
                for template, k, style, name in _slots(text):
                    rows.append((i, "strong" if style in STRONG_MARKERS else "blank" if style == "line" else "plain", template, k, name, None, None, None))
        if rows:
            types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in _TRACE.split(", ")])


def find_residue(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id) of every document in which residue replaces all or part of the content."""
    counts = evidence(documents)
    sets = counts.filter("kind IN ('pair', 'word')")
    blocks = max(1, -(-sets.count() // block))
    read = documents.filter("trim(text) <> ''").select("doc_id", "text")
    traces = None
    for b in range(blocks):
        got = sets.filter(F.pmod("key", F.lit(blocks)) == b).select("kind", "key").toArrow().to_pandas()
        tables = documents.sparkSession.sparkContext.broadcast(tuple(np.sort(got["key"][got["kind"] == k].to_numpy(np.int64)) for k in ("pair", "word")))

        def run(batches, tables=tables, first=b == 0):
            return _traces(batches, *tables.value, blocks, first)

        one = read.mapInArrow(run, _TRACE).withColumn("block", F.lit(b))
        traces = one if traces is None else traces.unionByName(one)
    traces = cut(traces)
    whole = traces.filter("kind IN ('pair', 'word')").groupBy("doc_id", "kind", "key", "name", "unit", "n", "block").agg(F.max("hits").alias("hits")).groupBy("doc_id", "kind", "key", "name", "unit", "n").agg(F.sum("hits").alias("hits"))
    made = whole.filter(f"hits >= CASE kind WHEN 'pair' THEN {TEMPLATE_SHARE} ELSE {FILLER_SHARE} END * n")
    aligned = traces.join(induced(counts), ["key", "slot"], "left_semi").filter("kind IN ('strong', 'blank')")
    named = traces.filter("kind IN ('strong', 'plain')").join(variable_names(counts), "name", "left_semi")
    same = traces.filter("kind = 'line'").join(counts.filter("kind = 'line'").select("key"), "key", "left_semi")
    found = [traces.filter("kind = 'sure'"), made, aligned, named, same]
    rows = found[0].select("doc_id")
    for more in found[1:]:
        rows = rows.unionByName(more.select("doc_id"))
    return rows.distinct()


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that are left when those with residue are taken out."""
    return documents.join(find_residue(documents), "doc_id", "left_anti")
