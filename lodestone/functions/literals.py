"""Object literals of JavaScript in source text: routes with their children, and the parts of stores.

A small reader of literals, in Python, as nesting has no bound: it keeps strings, names, objects and arrays, and takes any other expression as a
unit. Run through Pandas UDFs, a file at a time.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""//[^\n]*|/\*.*?\*/|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)|([A-Za-z_$][\w$]*)|(=>|\.\.\.|[^\s\w])|(\d[\w.]*)""", re.S)
_CLOSES = {"{": "}", "[": "]", "(": ")"}


class Word(str):
    """A name, or the first name of an expression that is not a literal."""


class Call(str):
    """An expression that is neither a literal nor a name: its tokens."""


def tokens(text: str) -> list[tuple[str, str]]:
    kinds = ("string", "name", "mark", "number")
    return [(kinds[m.lastindex - 1], m[0]) for m in _TOKEN.finditer(text) if m.lastindex]


def _skip(t: list, at: int) -> int:
    """Behind an expression: up to a comma or a closing mark of the level it starts on."""
    stack: list[str] = []
    while at < len(t):
        mark = t[at][1] if t[at][0] == "mark" else ""
        if not stack and mark in (",", "}", "]", ")", ";"):
            return at
        if mark in _CLOSES:
            stack.append(_CLOSES[mark])
        elif stack and mark == stack[-1]:
            stack.pop()
        at += 1
    return at


def value(t: list, at: int) -> tuple[object, int]:
    """The value that starts at a token, and where it ends."""
    end = _skip(t, at)
    if at >= len(t):
        return None, at
    kind, text = t[at]
    if end == at + 1 and kind == "string":
        return text[1:-1], end
    if end == at + 1 and kind == "name":
        return Word(text), end
    if text == "{" and kind == "mark":
        out, at = {}, at + 1
        while at < len(t) and t[at][1] != "}":
            while t[at][1] in ("async", "get", "set", "*") and at + 1 < len(t) and t[at + 1][0] == "name":
                at += 1
            if t[at][0] not in ("name", "string") or at + 1 >= len(t):
                at = _skip(t, at)
            elif t[at + 1][1] == ":":
                key = t[at][1] if t[at][0] == "name" else None  # only plain names are keys
                got, at = value(t, at + 2)
                if key is not None:
                    out[key] = got
            elif t[at + 1][1] == "(":  # a method
                out[t[at][1]] = Call("method")
                at = _skip(t, at)
            else:
                at = _skip(t, at)
            at += at < len(t) and t[at][1] == ","
            at += at < len(t) and t[at][1] in (")", "]", ";")
        return out, max(end, at)
    if text == "[" and kind == "mark":
        out, at = [], at + 1
        while at < len(t) and t[at][1] != "]":
            before = at
            got, at = value(t, at)
            out.append(got)
            at += at < len(t) and t[at][1] != "]"
            at += at == before
        return out, max(end, at)
    return Call(" ".join(x for _, x in t[at:end])), end


def _routes(rows: list, depth: int, above: str, out: list) -> None:
    for row in rows:
        if isinstance(row, dict) and isinstance(row.get("path"), str) and not isinstance(row["path"], (Word, Call)):
            part = row.get("component")
            shown = str(part) if isinstance(part, Word) else None if part is None else "(Dynamic Import)" if isinstance(part, Call) and ("=>" in part or part.startswith("import (")) else "(other)"
            name = row.get("name")
            out.append((row["path"], name if isinstance(name, str) and not isinstance(name, (Word, Call)) else None, shown, depth, above))
            if isinstance(row.get("children"), list):
                _routes(row["children"], depth + 1, row["path"], out)


def route_rows(text: str) -> list[tuple]:
    """path, name, component, depth, parent of the routes array of a file; objects without a path are left out, and what is below them."""
    t = tokens(text)
    for i in range(len(t) - 2):
        if t[i][1] == "routes" and t[i + 1][1] in (":", "=") and t[i + 2][1] == "[":
            out: list[tuple] = []
            _routes(value(t, i + 2)[0], 0, "", out)
            return out
    return []


def routes(text: Column) -> Column:
    """array of struct(path, name, component, depth, parent), parents before their children."""

    def run(s: pd.Series) -> pd.Series:
        names = ("path", "name", "component", "depth", "parent")
        return s.map(lambda x: [dict(zip(names, r)) for r in route_rows(x or "")])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<path:string,name:string,component:string,depth:int,parent:string>>")(text)


def store_rows(text: str) -> list[tuple]:
    """store, part (state, getter, action), name for every store defined by an options object."""
    t, out = tokens(text), []
    for i in range(len(t) - 3):
        if t[i][1] == "defineStore" and t[i + 1][1] == "(" and t[i + 2][0] == "string" and t[i + 3][1] == ",":
            name = t[i + 2][1][1:-1]
            options = value(t, i + 4)[0]
            if not isinstance(options, dict):  # set up by a function
                out.append((name, "setup", None))
                continue
            state = options.get("state")
            if isinstance(state, Call) and state.startswith("( ) => ( {"):
                inner = value(tokens(state), 4)[0]
                out += [(name, "state", k) for k, v in inner.items() if not (isinstance(v, Call) and v == "method")]
            for part in ("getters", "actions"):
                if isinstance(options.get(part), dict):
                    out += [(name, part[:-1], k) for k in options[part]]
    return out


def stores(text: Column) -> Column:
    """array of struct(store, part, name)."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [dict(zip(("store", "part", "name"), r)) for r in store_rows(x or "")])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<store:string,part:string,name:string>>")(text)


def export_leaves(text: Column) -> Column:
    """All paths of a package's exports field (JSON): its strings at any depth, in order, keys not among them."""
    return F.regexp_extract_all(text, F.lit(r'(?:[\[,:{]|^)\s*"((?:[^"\\]|\\.)*)"\s*(?=[,\]}]|$)'), F.lit(1))


def is_public(path: Column, entries: Column) -> Column:
    """Whether a file is one of a package's entry points (a path, or the end of one), or the index of src; without entry points none is."""
    plain = lambda p: F.replace(p, F.lit("\\"), F.lit("/"))
    listed = F.exists(entries, lambda e: F.endswith(plain(path), F.regexp_replace(plain(e), r"^\./", "")))
    return (F.size(entries) > 0) & (listed | plain(path).isin("src/index.ts", "src/index.js"))
