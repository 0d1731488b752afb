"""Sentences of texts in any of their languages and scripts.

Candidate boundaries are the places after terminal marks with their closing marks, line breaks, and white space in scripts
that set sentences apart by it. Each is classified by a maximum-entropy model over its neighbouring tokens, their case,
length, digits and script, the marks, quotes and brackets around it, and how often such tokens end or begin whole texts.

The model is trained on reliable places alone: ends of texts and paragraphs, marks that only end sentences, words that
often end texts before words that often begin them; and, as counterexamples, places inside quotes and brackets, before
lower case and commas, after tokens that never end a text. Token statistics cover all rows. The model is fitted on at most
about ``TRAIN_PLACES`` places of about ``TRAIN_TEXTS`` distinct texts, both chosen by hash.

Up to ``BROADCAST_TOKENS`` counted tokens the statistics are sent to the tasks; a larger table is joined to the tokens that
each text asks for. Both ways give the same sentences. Time is in proportion to the length of a text.

Defined cases: null, empty and blank texts have no sentences; offsets are code points without outer white space; rows with
the same key each give their sentences; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionloom.session import cut

TRAIN_TEXTS = 4_000
TRAIN_PLACES = 200_000
#: up to so many tokens with statistics (some 150 bytes each in a task) they are broadcast
BROADCAST_TOKENS = 500_000
#: counts under which a token says nothing, or a line is no heading
LEAST_TOKENS, LEAST_LINES = 8, 3
DIMENSIONS = 1 << 15
ROUNDS = 300

_MARKS = ".!?…。！？।؟۔"
_SURE = "。！？।؟۔"
_CLOSERS = "\"'”’»)]」』）】›“"
_OPENERS = "\"“„«‹([「『（【¿¡‘"
_PAIRS = {"(": ")", "[": "]", "（": "）", "【": "】", "「": "」", "『": "』", "«": "»", "‹": "›"}
_QUOTE_CLOSERS = "\"”»」』“›"
_MARK_OR_LINE = rf"(?P<mark>[{_MARKS}]+)(?P<close>(?:[   ]?[»›]|[{regex.escape(_CLOSERS)}])*)(?P<tail>[.,;،，]?)|(?P<line>\n)"
_CANDIDATE = regex.compile(_MARK_OR_LINE + r"|(?P<space>\s+)")
_CANDIDATE_SPACED = regex.compile(_MARK_OR_LINE)
_THAI = regex.compile(r"\p{Thai}")
_NESTING = regex.compile("[\n\"„“" + regex.escape("".join(_PAIRS)) + regex.escape(")]）】」』»›”") + "]")
_SPACE = regex.compile(r"\s*")
_TOKEN_BEFORE = regex.compile(r"(?r)[^\s\"“”„«»「」『』()（）\[\]]+$")
_TOKEN_AFTER = regex.compile(r"[\p{L}\p{N}][^\s\p{Ps}\p{Pe}\"“”«»,;:!?。！？।]*|\S")
_GLUED = regex.compile(r"^\S*[\p{Ll}\d)]{2}\.(?=\p{Lu})")  # a sentence set without a space after the one before
_LIST = regex.compile(r"[ \t]*(?:\d{1,3}[.)]|[-•*–])[ \t]")
_DIGITS = regex.compile(r"\d+")
_WORD_START = regex.compile(r"(?<!\S)\S")
_STOP_MARK = regex.compile(r"(?<=[^\s.])\.[\"'”’»)\]]*(?=\s|\Z)")
_RUN_BEFORE = regex.compile(r"(?r)\S*")
_END_OR_BLANK = regex.compile(r"\s*\Z|[ \t]*\n[ \t]*\n")
_WORD_LIKE = r"[^\s\p{Ps}\"“”«»¿¡][^\s\p{Ps}\p{Pe}\"“”«»,;:!?。！？।]*"
_ANY_TOKEN = regex.compile(_WORD_LIKE)
_FIRST_TOKEN = regex.compile(rf"(?:\A\s*|(?<=\n\n))[\"“„«(\[¿¡ \u00a0\t]*({_WORD_LIKE})")
_SCRIPTS = [("thai", regex.compile(r"\p{Thai}")), ("cjk", regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")), ("deva", regex.compile(r"\p{Devanagari}")), ("arab", regex.compile(r"\p{Arabic}")), ("cyrl", regex.compile(r"\p{Cyrillic}")), ("latn", regex.compile(r"\p{Latin}"))]
_LAST_LETTER = regex.compile(r"(?r)\p{L}")
_UNCASED = {"thai", "cjk", "deva", "arab"}


_SCRIPT_OF: dict[str, str] = {}


def _script(c: str) -> str:
    name = _SCRIPT_OF.get(c)
    if name is None:
        name = _SCRIPT_OF[c] = next((name for name, pattern in _SCRIPTS if pattern.match(c)), "none")
    return name


def _mask(token: str) -> str:
    return _DIGITS.sub("0", token)


def _end_of_content(text: str, end: int) -> int:
    """``end`` moved back over white space."""
    while end and text[end - 1].isspace():
        end -= 1
    return end


class _Depths:
    """Open quotes and brackets at any place; for each closing quote, whether a colon led to it."""

    def __init__(self, text: str) -> None:
        self.closed: dict[int, bool] = {}
        self.at, self.depth = [0], [0]
        odd = text.count('"') % 2
        stack: list[tuple[str, int]] = []
        waiting: Counter = Counter()
        for m in _NESTING.finditer(text):
            i, c = m.start(), m[0]
            if c == "\n" and (text[i + 1 : i + 2] == "\n" or odd and waiting['"']):
                stack.clear()
                waiting.clear()
            if stack and c == stack[-1][0]:
                _, start = stack.pop()
                waiting[c] -= 1
                k = _end_of_content(text, start)
                self.closed[i] = k > 0 and text[k - 1] in (":", "：")
            elif c in _PAIRS or c in '"„“':
                closer = _PAIRS.get(c) or ('"' if c == '"' else "”" if c == "“" or "“" not in text[i : i + 400] else "“")
                stack.append((closer, i))
                waiting[closer] += 1
            elif c in ")]）】」』»›" and waiting[c] > 0:
                while stack[-1][0] != c:
                    waiting[stack.pop()[0]] -= 1
                stack.pop()
                waiting[c] -= 1
                self.closed[i] = False
            if len(stack) != self.depth[-1]:
                self.at.append(i + 1)
                self.depth.append(len(stack))

    def inside(self, place: int) -> bool:
        return self.depth[bisect_right(self.at, place) - 1] > 0


class Statistics:
    """How often tokens stand before a full stop and end a text there, begin texts, and how often whole lines recur."""

    def __init__(self, before: dict[str, tuple[int, int]], after: dict[str, tuple[int, int]], lines: dict[str, int]) -> None:
        self.before, self.after, self.lines = before, after, lines

    def final(self, token: str) -> str:
        n, f = self.before.get(token, (0, 0))
        return "unseen" if n < LEAST_TOKENS else "never" if f < 0.004 * n else "rare" if f < 0.05 * n else "often"

    def starter(self, token: str) -> str:
        n, s = self.after.get(token, (0, 0))
        return "unseen" if n < LEAST_TOKENS and not s else "never" if s < 0.004 * n else "rare" if s < 0.05 * n else "often"

    def heading(self, line: str) -> bool:
        return self.lines.get(line, 0) >= LEAST_LINES


class _Asked(Statistics):
    """Notes what a text asks for."""

    def __init__(self) -> None:
        self.keys: set[tuple[str, str]] = set()

    def final(self, token: str) -> str:
        self.keys.add(("before", token))
        return "unseen"

    def starter(self, token: str) -> str:
        self.keys.add(("after", token))
        return "unseen"

    def heading(self, line: str) -> bool:
        self.keys.add(("line", line))
        return False


def _places(text: str, closed: dict[int, bool]):
    """(end of the sentence if it ends here, where the next may begin, kind, mark, closers) of all candidates."""
    thai, run_end = _THAI.search(text) is not None, 0
    for m in (_CANDIDATE if thai else _CANDIDATE_SPACED).finditer(text):
        kind = m.lastgroup if m["mark"] is None else "mark"
        if kind == "mark":
            mark, close, tail = m["mark"], m["close"], m["tail"]
            start, end = m.start("close"), m.end("close")
            opening = next((i for i in range(start, end) if text[i] in "“\"" and i not in closed), None) if close else None
            if opening is not None:  # it opens what follows
                end = opening
            elif tail == "." and close:
                end = m.end("tail")
            elif tail and tail != ".":
                continue
            after = _SPACE.match(text, end).end()
            if after == end and end < len(text):
                c = text[end]
                if not (c.isalpha() or c in _OPENERS or c.isdigit() and mark[-1] in _SURE) or mark == "." and not close and (c.islower() or c in "([\"“" or text[max(0, m.start() - 2) : m.start()].strip(" .(\"“\n\u00a0")[-2:-1] == "" and text[max(0, m.start() - 1)].isupper()):
                    continue
            yield end, after, "mark", mark, text[start:end].replace(" ", "").replace("\u00a0", "") if end > start else ""
        elif kind == "line":
            if m.start() < run_end:  # a further line break in one run of white space
                continue
            run_end = _SPACE.match(text, m.end()).end()
            stop = _end_of_content(text, m.start())
            if stop and text[stop - 1] in _CLOSERS:
                k = stop
                while k and text[k - 1] in _CLOSERS:
                    k -= 1
                ends = k and text[k - 1] in _MARKS
            else:
                ends = stop and text[stop - 1] in _MARKS
            if stop and not ends:
                yield stop, run_end, "line", "", ""
        elif "\n" not in m["space"]:
            last = _LAST_LETTER.search(text, max(0, m.start() - 12), m.start())
            if last and _script(last[0]) == "thai" or m.end() < len(text) and _script(text[m.end()]) == "thai" and text[m.start() - 1 : m.start()] not in tuple(_MARKS):
                yield m.start(), m.end(), "space", "", ""


class _Lines:
    """Where the line of a place starts and how many words (six at most) stand before the place; places come in order, or nearly."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.seen, self.counted = text, 0, 0, (0, 0, 0)

    def start_of(self, place: int) -> int:
        if place < self.seen:
            start = self.text.rfind("\n", 0, place) + 1
            if start != self.start:
                return start
        while (k := self.text.find("\n", self.seen, place)) >= 0:
            self.start = self.seen = k + 1
        self.seen = max(self.seen, place)
        return self.start

    def words(self, start: int, end: int) -> int:
        if start != self.counted[0] or end < self.counted[1]:
            self.counted = (start, start, 0)
        _, place, n = self.counted
        if n < 6:
            n = min(6, n + sum(1 for _ in islice(_WORD_START.finditer(self.text, place, end), 6)))
        self.counted = (start, end, n)
        return n


def candidates(text: str, stats: Statistics | None, labelled: bool = True):
    """(end, next start, features, label) of every candidate; features are (categories, token, token after, token before); label 1, 0, or None where the place is not reliable."""
    depths, lines_ = _Depths(text), _Lines(text)
    closed = depths.closed
    begin = _SPACE.match(text).end()
    earlier_place = None
    for end, after, kind, mark, close in _places(text, closed):
        if (end, after) == earlier_place or end <= begin:
            continue
        earlier_place = (end, after)
        at_end = after >= len(text)
        lines = text.count("\n", end, after)
        break_ = "end" if at_end else "blank" if lines > 1 else "line" if lines else "space" if after > end else "none"
        stop = end - len(close) if kind == "mark" else end
        left_at = max(0, stop - 60)
        m = _TOKEN_BEFORE.search(text, left_at, stop)
        token = m[0] if m else ""
        if "." in token:
            token = _GLUED.sub("", token)
        if close.endswith("."):  # the mark that counts stands after the closers
            token = ""
        word = _mask(token.rstrip(_MARKS) if kind == "mark" else token)
        before = stop - len(token)
        while before > left_at and text[before - 1].isspace():
            before -= 1
        m = _TOKEN_BEFORE.search(text, left_at, before)
        previous = _mask(m[0]) if m else ""
        right = _TOKEN_AFTER.search(text, after, after + 40)
        following = _mask(right[0]).rstrip(".") if right else ""
        first = text[after] if not at_end else ""
        opener = first if first in _OPENERS else ""
        bare = right[0][0] if opener and right else first
        sort = "end" if at_end else "list" if lines and _LIST.match(text, after) else "lower" if bare.islower() else "upper" if bare.isupper() else "digit" if bare.isdigit() else "letter" if bare.isalpha() else "other"
        letter = _LAST_LETTER.search(text, max(0, stop - 40), stop)
        script = _script(letter[0]) if letter else "none"
        line_start = lines_.start_of(stop)
        in_list = _LIST.match(text, line_start) is not None
        list_mark = kind == "mark" and mark == "." and in_list and stop - line_start < 6 and text[line_start:stop].strip().rstrip(".)").isdigit()
        shape = "digit" if word[-1:] == "0" and word.strip("0.,") == "" else "letter" if len(word) == 1 else "dotted" if "." in word else "upper" if word.isupper() else "title" if word.istitle() else "lower"
        inside = depths.inside(end)
        led = None
        if close and any(c in _QUOTE_CLOSERS for c in close):
            led = next((closed[i] for i in range(end - 1, stop - 1, -1) if i in closed and text[i] in _QUOTE_CLOSERS), None)
        low = word.lower()
        final = stats.final(low) if stats else "unseen"
        starter = stats.starter(following) if stats else "unseen"
        heading = kind == "line" and stats is not None and stats.heading(_mask(text[line_start:end].strip()))
        words = lines_.words(line_start, end)
        dots = mark[:1] == "…" or mark.startswith("..")
        number_ref = shape == "digit" and previous.endswith(".") and stats is not None and stats.final(previous.rstrip(".").lower()) in ("never", "rare")
        kinds = (kind, mark[-1:], dots, close[:2], break_, sort, opener, script, shape, min(len(word), 8), final, starter, inside, led, list_mark, in_list, number_ref, heading, words)
        yield end, after, (kinds, low, following, previous.lower()), _label(kinds, word) if labelled else None


def _label(kinds: tuple, word: str) -> int | None:
    """1 or 0 at reliable places."""
    kind, mark, dots, _, break_, sort, opener, script, shape, _, final, starter, inside, led, list_mark, in_list, number_ref, heading, _ = kinds
    if inside or list_mark:
        return 0
    if kind == "space":
        return 1
    if kind == "line":
        return 1 if break_ in ("blank", "end") or sort == "list" else 0 if sort == "lower" else 1 if heading or in_list else None
    if break_ in ("end", "blank"):
        return 1
    if led is not None and (led or script in _UNCASED) and sort not in ("upper", "lower"):
        return int(led)
    if dots:
        return 0 if sort == "lower" or break_ == "none" and sort == "letter" or script in _UNCASED and break_ in ("none", "space") and sort != "upper" else 1 if sort in ("upper", "digit") else None
    if mark and mark in _SURE:
        return 1
    if sort == "other" and not opener:
        return 0
    if mark in "!?":
        return 0 if sort == "lower" else 1
    if final == "never":
        return 0
    if sort == "lower":
        return int(starter == "often")
    if shape == "digit":
        return 1 if number_ref and sort != "lower" else 0 if starter == "never" or sort == "digit" else 1 if starter == "often" else None
    if sort == "digit" and final in ("often", "rare") or opener and final == "often":
        return 1
    if sort in ("upper", "letter") and starter in ("often", "rare"):
        return 1
    return 1 if shape == "lower" and len(word) > 4 else None


def _category_names(kinds: tuple) -> list[str]:
    kind, mark, dots, close, break_, sort, opener, script, shape, size, final, starter, inside, led, list_mark, in_list, number_ref, heading, words = kinds
    return [
        f"k={kind}", f"m={mark}{'s' if dots else ''}", f"c={close}", f"b={break_}", f"n={sort}", f"o={opener}", f"s={script}", f"h={shape}", f"l={size}",
        f"F={final}", f"S={starter}", f"in={inside}", f"led={led}", f"lm={list_mark}", f"il={in_list}",
        f"kb={kind}{break_}{sort}", f"Fn={final}{sort}{mark}", f"hS={shape}{starter}{sort}", f"ms={mark}{script}{sort}", f"ls={led}{script}{sort}", f"nr={number_ref}{sort}{shape}", f"FS={final}{starter}{sort}",
        f"hd={heading}{sort}{kind}", f"wl={words}{sort}{kind}", f"dn={dots}{script}{sort}", f"li={in_list}{sort}{kind}",
    ]


def _token_names(features: tuple) -> list[str]:
    return [f"w={features[1]}", f"f={features[2]}", f"pw={features[3]}"]


class Model:
    """Weights of the maximum-entropy model; sums of what recurs are kept."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.known: dict = {}

    def weight(self, name: str) -> float:
        w = self.known.get(name)
        if w is None:
            w = self.known[name] = float(self.weights[xxhash.xxh32_intdigest(name) % DIMENSIONS])
        return w

    def ends(self, features: tuple) -> bool:
        if len(self.known) > 300_000:
            self.known.clear()
        base = self.known.get(features[0])
        if base is None:
            base = self.known[features[0]] = sum(map(self.weight, _category_names(features[0]))) + float(self.weights[-1])
        return base + sum(map(self.weight, _token_names(features))) > 0


def _hash(names: list[str], known: dict[str, int]) -> list[int]:
    out = []
    for n in names:
        h = known.get(n)
        if h is None:
            if len(known) > 200_000:
                known.clear()
            h = known[n] = xxhash.xxh32_intdigest(n) % DIMENSIONS
        out.append(h)
    return out


def _count(batches):
    """Statistics of this task, as (kind, token, all, reliable)."""
    before: dict[str, list[int]] = {}
    tokens: Counter = Counter()
    firsts: Counter = Counter()
    lines: Counter = Counter()

    def rows():
        after: dict[str, list[int]] = {}
        for k, found in enumerate((tokens, firsts)):
            for token, n in found.items():
                after.setdefault(_mask(token).rstrip("."), [0, 0])[k] += n
        data = [("before", k, *v) for k, v in before.items()] + [("after", k, *v) for k, v in after.items()] + [("line", k, v, 0) for k, v in lines.items()]
        kinds, keys, n, r = zip(*data, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys), pa.array(n, pa.int64()), pa.array(r, pa.int64())], names=["kind", "token", "n", "reliable"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for m in _STOP_MARK.finditer(text):
                left = _TOKEN_BEFORE.search(_GLUED.sub("", _RUN_BEFORE.search(text, 0, m.start())[0]))
                if left:
                    v = before.setdefault(_mask(left[0]).lower(), [0, 0])
                    v[0] += 1
                    v[1] += _END_OR_BLANK.match(text, m.end()) is not None
            tokens.update(_ANY_TOKEN.findall(text))
            firsts.update(_FIRST_TOKEN.findall(text))
            for line in text.split("\n")[:-1]:
                line = line.strip()
                if line and len(line) <= 40 and line[-1] not in _MARKS + _CLOSERS and not _LIST.match(line):
                    lines[_mask(line)] += 1
            if len(before) + len(tokens) + len(lines) > 200_000:
                yield rows()
                before.clear(), tokens.clear(), firsts.clear(), lines.clear()
    if before or tokens or lines:
        yield rows()


def counted(texts: DataFrame) -> DataFrame:
    """(kind, token, n, r) over all texts, of every token and line that can be told from an unseen one."""
    counts = texts.mapInArrow(_count, "kind string, token string, n bigint, reliable bigint").groupBy("kind", "token").agg(F.sum("n").alias("n"), F.sum("reliable").alias("r"))
    return counts.filter(f"kind = 'before' AND n >= {LEAST_TOKENS} OR kind = 'after' AND (n >= {LEAST_TOKENS} OR r > 0) OR kind = 'line' AND n >= {LEAST_LINES}")


def _as_statistics(rows) -> Statistics:
    got: dict[str, dict[str, tuple[int, int]]] = {"before": {}, "after": {}, "line": {}}
    for r in rows:
        got[r["kind"]][r["token"]] = (r["n"], r["r"])
    return Statistics(got["before"], got["after"], {k: n for k, (n, _) in got["line"].items()})


def statistics(texts: DataFrame) -> Statistics:
    return _as_statistics(counted(texts).toArrow().to_pylist())


def asked_statistics(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """(print, stats): of each distinct text the counts that it asks for."""

    def ask(batches):
        for batch in batches:
            prints, kinds, tokens = [], [], []
            for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked = _Asked()
                for _ in candidates(t, asked, labelled=False):
                    pass
                for kind, token in asked.keys:
                    prints.append(p), kinds.append(kind), tokens.append(token)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (prints, kinds, tokens)], names=["print", "kind", "token"])

    keys = texts.select(F.sha2("text", 256).alias("print"), "text").mapInArrow(ask, "print string, kind string, token string").distinct()
    return keys.join(counts, ["kind", "token"]).groupBy("print").agg(F.collect_list(F.struct("kind", "token", "n", "r")).alias("stats"))


def fit(rows: list[tuple[list[int], int]], rounds: int = ROUNDS, decay: float = 1e-5) -> np.ndarray:
    """Weights of a maximum-entropy model (the last is the bias) by gradient steps with momentum and per-weight scale."""
    w = np.zeros(DIMENSIONS + 1)
    if not rows:
        return w
    size = np.array([len(f) for f, _ in rows])
    x = np.fromiter((i for f, _ in rows for i in f), np.int64, size.sum())
    row = np.repeat(np.arange(len(rows)), size)
    y = np.array([label for _, label in rows], float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[x], len(y)) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.append(np.bincount(x, e[row], DIMENSIONS), e.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _chosen(h: Column, most: int, n: int) -> Column:
    """Of n evenly spread 64-bit hashes about ``most``, always the same ones."""
    return F.lit(True) if n <= most else h < F.lit(int(-(1 << 63) + (1 << 64) * (most / n)))


def sample_texts(texts: DataFrame, most: int = TRAIN_TEXTS) -> DataFrame:
    """About ``most`` distinct texts, chosen by hash."""
    hashed = texts.select("text", F.xxhash64("text").alias("h"))
    n = hashed.select("h").distinct().count()
    return hashed.filter(_chosen(F.col("h"), most, n)).select("text").distinct()


def train(texts: DataFrame, stats: Statistics, most: int = TRAIN_TEXTS, places: int = TRAIN_PLACES) -> np.ndarray:
    sample = sample_texts(texts, most).repartition(6)

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = [(_hash(_category_names(f[0]) + _token_names(f), known), label, end) for end, _, f, label in candidates(t, stats) if label is not None]
                own = xxhash.xxh64(t)
                for start in range(0, len(found), 10_000):
                    part = found[start : start + 10_000]
                    h = [xxhash.xxh64_intdigest(end.to_bytes(8, "little"), own.intdigest()) - (1 << 63) for _, _, end in part]
                    yield pa.RecordBatch.from_arrays([pa.array([f for f, _, _ in part], pa.list_(pa.int32())), pa.array([y for _, y, _ in part], pa.int32()), pa.array(h, pa.int64())], names=["f", "y", "h"])

    found = cut(sample.mapInArrow(run, "f array<int>, y int, h bigint"))
    got = found.filter(_chosen(F.col("h"), places, found.count())).toArrow().sort_by("h")
    return fit(list(zip(got.column("f").to_pylist(), got.column("y").to_pylist(), strict=True)))


def split(text: str, stats: Statistics, model: Model) -> list[tuple[int, int]]:
    """(start, end) of every sentence, without outer white space."""
    out, start = [], _SPACE.match(text).end()
    for end, after, features, _ in candidates(text, stats, labelled=False):
        if end > start and model.ends(features):
            out.append((start, end))
            start = after
    stop = _end_of_content(text, len(text))
    if stop > start:
        out.append((start, stop))
    return out


def sentences(rows: DataFrame, key: str = "passage_id", text: str = "text", most: int = TRAIN_TEXTS, broadcast: int = BROADCAST_TOKENS) -> DataFrame:
    """(key, sent_no, start_char, end_char) of every sentence; no shuffle of the texts while the statistics can be sent to the tasks."""
    full = rows.filter(F.col(text).isNotNull() & (F.trim(text) != "")).select(F.col(key).alias("_key"), F.col(text).alias("text"))
    plain = full.select("text")
    counts = cut(counted(plain))
    kind = rows.schema[key].dataType.simpleString()
    small = counts.count() <= broadcast
    if small:
        stats = _as_statistics(counts.toArrow().to_pylist())
        read = full
    else:
        sample = cut(sample_texts(plain, most))
        stats = _as_statistics(r for row in asked_statistics(sample, counts).select(F.explode("stats").alias("s")).select("s.*").distinct().toLocalIterator() for r in [row])
        read = full.withColumn("print", F.sha2("text", 256)).join(asked_statistics(plain, counts), "print", "left").select("_key", "text", F.coalesce("stats", F.array().cast("array<struct<kind:string,token:string,n:bigint,r:bigint>>")).alias("stats"))
    sent = rows.sparkSession.sparkContext.broadcast((stats if small else None, train(plain if small else sample, stats, most)))

    def run(batches):
        known, weights = sent.value
        model = Model(weights)
        for batch in batches:
            at, no, starts, ends = [], [], [], []
            own = batch.column(2).to_pylist() if known is None else None
            for i, t in enumerate(batch.column(1).to_pylist()):
                for j, (a, b) in enumerate(split(t, known or _as_statistics(own[i]), model)):
                    at.append(i), no.append(j), starts.append(a), ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(no, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "sent_no", "start_char", "end_char"])

    return read.mapInArrow(run, f"{key} {kind}, sent_no int, start_char int, end_char int")
