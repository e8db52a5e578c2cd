"""Reader of the extensible data notation that queries, documents and transactions may be written in."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from decimal import Decimal
from fractions import Fraction


@dataclass(frozen=True, order=True)
class Symbol:
    name: str

    def __repr__(self) -> str:
        return self.name


@dataclass(frozen=True, order=True)
class Keyword:
    name: str

    def __repr__(self) -> str:
        return f":{self.name}"


class Call(tuple):
    """A list form `( ... )`; vectors are Python lists."""

    __slots__ = ()

    def __repr__(self) -> str:
        return f"({' '.join(map(repr, self))})"


class Pairs(dict):
    """A map whose keys may be unhashable forms keeps them as frozen copies."""


S, K = Symbol, Keyword
_TOKEN = re.compile(r"""[\s,]+|;[^\n]*|(?P<open>\#\{|[\[({])|(?P<close>[\])}])|(?P<discard>\#_)|(?P<tag>\#[A-Za-z][\w./-]*)|(?P<quote>')|(?P<string>"(?:\\.|[^"\\])*")|(?P<char>\\(?:newline|space|tab|return|.))|(?P<atom>[^\s,;\[\](){}"']+'*)""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}
_CHARS = {"newline": "\n", "space": " ", "tab": "\t", "return": "\r"}
_CLOSING = {"[": "]", "(": ")", "{": "}", "#{": "}"}


def instant(text: str) -> datetime:
    """RFC 3339, possibly cut short after year, month, day, hour, minute or second; UTC if no offset is given."""
    m = re.fullmatch(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:[T ](\d\d)(?::(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?)?)?)?)?(Z|[+-]\d\d:?\d\d)?", text)
    if not m:
        raise ValueError(f"not an instant: {text!r}")
    y, mo, d, h, mi, s = (int(x) if x else low for x, low in zip(m.groups()[:6], (1970, 1, 1, 0, 0, 0), strict=True))
    out = datetime(y, mo, d, h, mi, s, int((m[7] or "0").ljust(9, "0")[:6]), tzinfo=timezone.utc)
    if m[8] and m[8] != "Z":
        offset = datetime.strptime(m[8].replace(":", ""), "%z").utcoffset()
        out -= offset
    return out


def _atom(text: str) -> object:
    if text in ("nil", "true", "false"):
        return {"nil": None, "true": True, "false": False}[text]
    if text[0] == ":" and len(text) > 1:
        return Keyword(text[1:])
    if re.fullmatch(r"[+-]?\d+N?", text):
        return int(text.rstrip("N"))
    if re.fullmatch(r"[+-]?\d+/\d+", text):
        return Fraction(text)
    if re.fullmatch(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?M?", text):
        return Decimal(text[:-1]) if text[-1] == "M" else float(text)
    return Symbol(text)


def freeze(form: object) -> object:
    """A hashable copy of a form."""
    if isinstance(form, dict):
        return frozenset((freeze(k), freeze(v)) for k, v in form.items())
    if isinstance(form, (list, tuple)):
        return tuple(freeze(x) for x in form)
    if isinstance(form, (set, frozenset)):
        return frozenset(freeze(x) for x in form)
    return form


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def token(self) -> tuple[str, str]:
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise ValueError(f"can't read at {self.text[self.at : self.at + 20]!r}")
            self.at = m.end()
            if m.lastgroup:
                return m.lastgroup, m[m.lastgroup]
        raise EOFError("the form ends early")

    def form(self) -> object:
        kind, text = self.token()
        if kind == "close":
            raise ValueError(f"unexpected {text}")
        return self.of(kind, text)

    def of(self, kind: str, text: str) -> object:
        if kind == "open":
            items = []
            while True:
                inner, token = self.token()
                if inner == "close":
                    if token != _CLOSING[text]:
                        raise ValueError(f"{token} closes {text}")
                    break
                if inner == "discard":
                    self.form()
                    continue
                items.append(self.of(inner, token))
            if text == "[":
                return items
            if text == "(":
                return Call(items)
            if text == "#{":
                return frozenset(freeze(x) for x in items)
            if len(items) % 2:
                raise ValueError("a map needs as many values as keys")
            return Pairs((freeze(k) if isinstance(k, (list, dict, Call)) else k, v) for k, v in zip(items[::2], items[1::2], strict=True))
        if kind == "discard":
            self.form()
            return self.form()
        if kind == "quote":
            return self.form()
        if kind == "string":
            return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), text[1:-1])
        if kind == "char":
            return _CHARS.get(text[1:], text[1:])
        if kind == "tag":
            value = self.form()
            if text == "#inst":
                return instant(value)
            if text == "#uuid":
                return uuid.UUID(value)
            return value
        return _atom(text)


def read(text: str) -> object:
    """The first form in a text."""
    return _Reader(text).form()
