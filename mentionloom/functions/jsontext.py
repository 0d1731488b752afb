"""JSON text of any depth: a reader with an explicit stack that can also keep what is complete of a text that is cut off."""

from __future__ import annotations

import json
import re
from typing import Any

_TOKEN = re.compile(r'[ \t\r\n]*(?:(?P<sign>[{}\[\],:])|"(?P<text>[^"\\]*(?:\\.[^"\\]*)*)"|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<word>true|false|null)|(?P<end>\Z))', re.S)
_WORDS = {"true": True, "false": False, "null": None}
_CONTROL = re.compile(r"[\x00-\x1f]")
_NOTHING = object()


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


def _scalar(m: re.Match, strict: bool) -> Any:
    if (raw := m["text"]) is not None:
        if strict and _CONTROL.search(raw):
            raise ValueError("control character in a string")
        return json.loads(f'"{raw}"', strict=False) if "\\" in raw else raw
    return json.loads(m["number"]) if m["number"] is not None else _WORDS[m["word"]]


class _Open:
    """A list or object that is not closed yet. ``wants`` is what may come next: value, key, colon or comma."""

    __slots__ = ("items", "key", "wants")

    def __init__(self, items: list | dict) -> None:
        self.items, self.key, self.wants = items, None, "key" if isinstance(items, dict) else "value"

    def put(self, value: Any) -> None:
        if isinstance(self.items, dict):
            self.items[self.key] = value
        else:
            self.items.append(value)
        self.wants = "comma"


def walk(text: str, at: int = 0, strict: bool = True) -> tuple[Any, int, str]:
    """(value, position after it, state) of the value at ``at``; state is whole, cut (the text ends first) or broken.

    Of a cut or broken value the complete members are kept; an unfinished object in a list is left out. ``_NOTHING`` if there is no member.
    """
    stack: list[_Open] = []
    while True:
        m = _TOKEN.match(text, at)
        state = "cut" if m is not None and m["end"] is not None else "broken"
        if m is None and (quote := re.compile(r'[ \t\r\n]*"').match(text, at)):
            state = "cut" if re.compile(r'[^"\\]*(?:\\.[^"\\]*)*\\?\Z', re.S).match(text, quote.end()) else "broken"
        if m is None or m["end"] is not None:
            break
        top = stack[-1] if stack else None
        sign, wants, value = m["sign"], top.wants if top else "value", _NOTHING
        if sign in ("{", "["):
            if wants != "value":
                break
            stack.append(_Open({} if sign == "{" else []))
        elif sign in ("}", "]"):
            empty = top is not None and not top.items and wants != "comma" and top.key is None
            if top is None or isinstance(top.items, dict) != (sign == "}") or not (wants == "comma" or empty):
                break
            value = stack.pop().items
        elif sign == ",":
            if wants != "comma":
                break
            top.wants, top.key = ("key", "") if isinstance(top.items, dict) else ("value", "")
        elif sign == ":":
            if wants != "colon":
                break
            top.wants = "value"
        else:
            try:
                value = _scalar(m, strict)
            except ValueError:
                break
            if wants == "key" and m["text"] is not None:
                top.key, top.wants, value = value, "colon", _NOTHING
            elif wants != "value":
                break
        at = m.end()
        if value is not _NOTHING:
            if not stack:
                return value, at, "whole"
            stack[-1].put(value)
    kept = _NOTHING
    while stack:
        last = stack.pop()
        if kept is not _NOTHING:
            last.put(kept)
        loose = isinstance(last.items, dict) and stack and isinstance(stack[-1].items, list)
        kept = _NOTHING if loose else last.items
    return kept, at, state


def read(text: str) -> Any:
    """The value of a text that is one whole JSON value, however deep; ``ValueError`` otherwise, also for NaN and Infinity."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        value, at, state = walk(text)
        if state != "whole" or text[at:].strip(" \t\r\n"):
            raise ValueError("not one whole JSON value") from None
        return value


def write(value: Any) -> str:
    """``value`` as JSON text, however deep."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        out, rest = [], [value]
        while rest:
            x = rest.pop()
            if isinstance(x, _Raw):
                out.append(x)
            elif isinstance(x, dict):
                parts = [p for k, v in x.items() for p in (_Raw(", "), _Raw(json.dumps(k, ensure_ascii=False) + ": "), v)]
                rest += [_Raw("}"), *reversed(parts[1:]), _Raw("{")]
            elif isinstance(x, list):
                parts = [p for v in x for p in (_Raw(", "), v)]
                rest += [_Raw("]"), *reversed(parts[1:]), _Raw("[")]
            else:
                out.append(json.dumps(x, ensure_ascii=False))
        return "".join(out)


class _Raw(str):
    __slots__ = ()


def recover(reply: str) -> Any:
    """The first complete object or list of a reply that may be fenced or stand in prose, else what is complete of the one that is cut off.

    ``ValueError`` if there is neither. A reply that is one scalar stands for itself.
    """
    try:
        return read(reply.strip())
    except ValueError:
        pass
    at, partial = 0, _NOTHING
    while (m := re.compile(r"[\[{]").search(reply, at)) is not None:
        value, after, state = walk(reply, m.start(), strict=False)
        if state == "whole":
            return value
        if partial is _NOTHING and value is not _NOTHING and value:
            partial = value
        if state == "cut":
            break
        at = max(after, m.end())
    if partial is _NOTHING:
        raise ValueError("no JSON in the reply")
    return partial
