"""A lexer for assignments in source, configuration and markup: names and the literals that they hold.

It reads a text once, token by token, with a stack of what is open: nested keys by
indentation (YAML), braces and lists (JSON, literals of most languages) and elements
with attributes (XML). Strings are of all common kinds (escaped, triple-quoted, raw
prefixes, here-documents, block scalars, CDATA); a value may be put together by ``+``, by
standing side by side, in parentheses over several lines, from constants, or be the
default in a call. Comments are read like the rest, for secrets that are commented out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Span = tuple[int, int]
#: A name (with what it is nested in) and the pieces of one literal that it holds.
Pair = tuple[str, list[Span]]

STRING = r""""(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`"""
_TOKEN = re.compile(
    rf"""[ \t\r]*+(?:(?P<triple>\"{{3}}(?s:[^"\\]|\\.|"(?!""))*+\"{{3}}|'{{3}}(?s:[^'\\]|\\.|'(?!''))*+'{{3}})|(?P<string>{STRING})"""
    r"""|(?P<line>\n[ \t]*+)|(?P<joint>\\\n)|(?P<here><<[-~]?(?P<quote>["']?)(?P<mark>[A-Za-z_]\w*+)(?P=quote))"""
    r"""|(?P<tag><[A-Za-z_][\w.:-]*+(?=[\s/>]))|(?P<block>[|>][0-9]?[+-]?[0-9]?[ \t]*+(?=\n))"""
    r"""|(?P<name>[A-Za-z_$][\w.$-]*+)|(?P<sign>=>|:=|[=!<>]=+|::+|[=:])|(?P<mark_>[-+,;.(){}\[\]])|(?P<rest>.))""",
    re.ASCII,
)
_BARE = re.compile(r"""\$?\{?[^\s"'`,;(){}\[\]<>#]++\}?""", re.ASCII)
_REFERENCE = re.compile(r"^(?:\$\{?)?([A-Za-z_$][\w.$-]*)\}?$", re.ASCII)
_JOINED = re.compile(r"""[A-Za-z_$][\w.$]*+(?:[ \t]++\+[ \t\n]|[ \t]*+\+[ \t]*+["'`])""", re.ASCII)
_CALL = re.compile(r"[A-Za-z_$][\w.$]*+[ \t]*+\(", re.ASCII)
_TYPE = re.compile(r"[ \t]*+[A-Za-z_][\w.\[\]]*+[ \t]*+=(?!=)", re.ASCII)
_ITEM = re.compile(r"""\[["']([\w.-]++)["']\]""", re.ASCII)
_ELEMENT = re.compile(r"""<([A-Za-z_][\w.:-]*+)((?:\s++[\w:.-]++(?:\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'))?+)*+)\s*+(/?)>""", re.ASCII)
_ATTRIBUTE = re.compile(r"""([\w:.-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""", re.ASCII)
_WORD_KEY = re.compile(r"[\w.$ -]+", re.ASCII)
_PREFIX = re.compile(r"[bBrRuUfF]{1,2}(?=[\"'])")
#: Calls whose first argument names what they look up: only what follows can be a literal of theirs.
_LOOKUP = re.compile(r"env|get|input|prompt|lookup|read|find|config|setting", re.IGNORECASE)
#: Attributes that name an element, and keys that hold the value of what they are nested in; fixed values.
NAMING = frozenset(("name", "key", "id"))
GENERIC = frozenset(("value", "val", "default", "data", "content", "text", "raw"))


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self._closing, self._missing = text, 0, None, set()

    def token(self, at: int) -> re.Match | None:
        return _TOKEN.match(self.text, at)

    def closing(self, at: int) -> int:
        """Where the parenthesis at ``at`` is closed, -1 if nowhere; found for all of them at once."""
        if self._closing is None:
            self._closing, open_, here = {}, [], 0
            while t := self.token(here):
                here = t.end()
                if t.lastgroup == "mark_" and t["mark_"] == "(":
                    open_.append(t.start("mark_"))
                elif t.lastgroup == "mark_" and t["mark_"] == ")" and open_:
                    self._closing[open_.pop()] = t.start("mark_")
        return self._closing.get(at, -1)

    def upto(self, end: str, at: int) -> int:
        """Where ``end`` stands next, -1 if nowhere (asked once)."""
        if end in self._missing:
            return -1
        found = self.text.find(end, at)
        if found < 0:
            self._missing.add(end)
        return found

    def closed_by(self, mark: str, at: int) -> int:
        """Where the line that ends a here-document begins, -1 if nowhere (asked once)."""
        if (key := f"\n{mark}") in self._missing:
            return -1
        found = re.compile(rf"\n[ \t]*+{mark}\b", re.ASCII).search(self.text, at)
        if not found:
            self._missing.add(key)
        return found.start() if found else -1

    def lines(self, start: int, end: int) -> list[Span]:
        """What stands on each line between ``start`` and ``end``, without the blanks around it."""
        out, at = [], start
        for line in self.text[start:end].split("\n"):
            inner = line.strip()
            if inner:
                first = at + line.index(inner)
                out.append((first, first + len(inner)))
            at += len(line) + 1
        return out


def _inner(token: re.Match) -> Span:
    n = 3 if token.lastgroup == "triple" else 1
    start, end = token.span(token.lastgroup)
    return start + n, end - n


def _expression(reader: _Reader, at: int, constants: dict[str, list[Span]], end: int = -1) -> tuple[list[Span], int]:
    """Pieces of the value at ``at``, put together by ``+`` or side by side, and where it ends; up to ``end``, over lines, if that is given."""
    spans: list[Span] = []
    joined = True  # an operand may follow
    while (t := reader.token(at)) and (end < 0 or t.start(t.lastgroup) < end):
        kind = "here" if t["here"] else t.lastgroup
        if kind in ("string", "triple"):
            spans += reader.lines(*_inner(t)) if "\n" in t[0] else [_inner(t)]
            joined = False
        elif kind == "name" and (p := _PREFIX.match(t["name"] + reader.text[t.end() : t.end() + 1])) and p.end() == len(t["name"]):
            pass  # of a string
        elif kind == "name" and joined:
            spans += constants.get(t["name"].lstrip("$"), constants.get(t["name"], []))
            joined = False
        elif kind == "mark_" and t["mark_"] in "+.":
            joined = True
        elif kind == "joint" or (kind == "line" and (end >= 0 or (joined and spans))):
            pass
        elif kind == "rest" and t["rest"] in "#/" and end >= 0:
            line = reader.text.find("\n", t.end())
            at = line if 0 <= line < end else end
            continue
        else:
            break
        at = t.end()
    return spans, at


def _arguments(reader: _Reader, start: int, end: int, depth: int = 3) -> list[tuple[int, Span]]:
    """(argument's number, literal) of the strings between two parentheses; what is nested deeper is passed over."""
    out, number, at = [], 0, start
    while (t := reader.token(at)) and t.start(t.lastgroup) < end:
        at = t.end()
        if t.lastgroup in ("string", "triple"):
            out.append((number, _inner(t)))
        elif t.lastgroup == "mark_" and t["mark_"] == ",":
            number += 1
        elif t.lastgroup == "mark_" and t["mark_"] == "[":
            at = _past_item(reader, at)
        elif t.lastgroup == "mark_" and t["mark_"] == "(":
            closed = reader.closing(t.start("mark_"))
            if depth and 0 <= closed < end:
                out += [(number, s) for _, s in _arguments(reader, at, closed, depth - 1)]
            at = closed + 1 if closed >= 0 else end
    return out


def _past_item(reader: _Reader, at: int) -> int:
    item = _ITEM.match(reader.text, at - 1)
    return item.end() if item else at


def pairs(text: str) -> Iterator[Pair]:
    """The names and literals of ``text``, in the order of their values."""
    reader, constants = _Reader(text), {}
    frames: list[tuple[int, str, bool]] = []  # indentation (-1: a bracket), name, a list
    indent, at = 0, 0
    if (first := re.match(r"[ \t]*", text)) is not None:
        indent = first.end()

    def qualified(name: str) -> str:
        if name.lower() in GENERIC:
            for _, outer, _ in reversed(frames):
                if outer:
                    return f"{outer}.{name}"
        return name

    def held(name: str, groups: list[list[Span]]) -> Iterator[Pair]:
        groups = [g for g in groups if g]
        if len(groups) == 1:
            constants[name] = groups[0]
        yield from ((qualified(name), g) for g in groups)

    while t := reader.token(at):
        kind, at = ("here" if t["here"] else t.lastgroup), t.end()
        if kind == "line":
            indent = len(t["line"]) - 1
            if not text.startswith("\n", at):
                while frames and frames[-1][0] >= indent:
                    frames.pop()
            continue
        if kind == "tag":
            element = _ELEMENT.match(text, t.start("tag"))
            if not element:
                continue
            at = element.end()
            attributes = {m[1].lower().rpartition(":")[2]: m for m in _ATTRIBUTE.finditer(text, *element.span(2))}
            spans = {k: [m.span(2) if m[2] is not None else m.span(3)] for k, m in attributes.items()}
            yield from ((k, s) for k, s in spans.items())
            names = [text[s[0][0] : s[0][1]] for k, s in spans.items() if k in NAMING]
            yield from ((n, spans["value"]) for n in names if "value" in spans)
            if element[3]:
                continue
            if text.startswith("<![CDATA[", at):
                start, end = at + 9, reader.upto("]]>", at + 9)
                after = end + 3
            else:
                start, end = at, reader.upto("<", at)
                after = end
            if end >= 0 and text.startswith(f"</{element[1]}", after):
                yield from ((n, reader.lines(start, end)) for n in (element[1], *names) if text[start:end].strip())
            continue
        if kind == "mark_":
            if t["mark_"] in "{[(":
                frames.append((-1, "", t["mark_"] == "["))
            elif t["mark_"] in "}])":
                while frames and frames.pop()[0] >= 0:
                    pass
            continue
        if kind not in ("name", "string", "triple"):
            continue
        name = t["name"] if kind == "name" else text[slice(*_inner(t))]
        item = _ITEM.match(text, at)
        if item:
            name, at = item[1], item.end()
        sign = reader.token(at)
        if not sign or sign.lastgroup != "sign" or sign["sign"] not in ("=", ":", ":=", "=>") or (kind != "name" and not _WORD_KEY.fullmatch(name)):
            if kind != "name" and frames and frames[-1][2] and frames[-1][1]:  # a member of a list
                spans, at = _expression(reader, t.start(kind), constants)
                yield qualified(frames[-1][1]) if frames[-1][1].lower() in GENERIC else frames[-1][1], spans
            continue
        at = sign.end()
        if sign["sign"] == ":" and (kind_of := _TYPE.match(text, at)):
            at = kind_of.end()
        key_at, value = indent, reader.token(at)
        if value and value.lastgroup == "line":  # the value may stand on the next line
            below = reader.token(value.end())
            while below and below.lastgroup == "line":
                value, below = below, reader.token(below.end())
            deeper = len(value["line"]) - 1 > key_at
            if below and below.lastgroup in ("string", "triple") and deeper:
                after = reader.token(below.end())
                if not (after and after.lastgroup == "sign"):
                    at, indent, value = value.end(), len(value["line"]) - 1, below
            elif below and deeper and sign["sign"] == ":" and (bare := _BARE.match(text, value.end())) and ":" not in bare[0] and "=" not in bare[0] and text[bare.end() : bare.end() + 1] in ("", "\n", "\r"):
                at, indent, value = value.end(), len(value["line"]) - 1, below
            if value.lastgroup == "line":
                if sign["sign"] == ":":
                    frames.append((key_at, name, True))
                continue
        if not value:
            break
        here = value.start("here" if value["here"] else value.lastgroup)
        if value["here"]:
            body = reader.upto("\n", value.end())
            end = -1 if body < 0 else reader.closed_by(value["mark"], body)
            if end >= 0:
                yield from held(name, [reader.lines(body, end)])
                at = end
        elif value.lastgroup == "block" and sign["sign"] == ":":
            end = value.end()
            while (line := re.compile(r"\n(?:([ \t]*+)(?=[^\s])[^\n]*|[ \t]*(?=\n|$))").match(text, end)) and (line[1] is None or len(line[1]) > key_at) and line.end() > end:
                end = line.end()
            yield from held(name, [reader.lines(value.end(), end)])
            at = end
        elif value.lastgroup == "mark_" and value["mark_"] in "{[":
            frames.append((-1, name, value["mark_"] == "["))
            at = value.end()
        elif value.lastgroup == "mark_" and value["mark_"] == "(":
            end = reader.closing(here)
            if end >= 0:
                spans, stop = _expression(reader, value.end(), constants, end)
                if spans and stop <= end and not text[stop:end].strip():
                    yield from held(name, [spans])
                    at = end + 1
        elif value.lastgroup in ("string", "triple") or _JOINED.match(text, here) or (_PREFIX.match(text, here)):
            spans, at = _expression(reader, here, constants)
            yield from held(name, [spans])
        elif (call := _CALL.match(text, here)) and (end := reader.closing(call.end() - 1)) >= 0:
            found = _arguments(reader, call.end(), end)
            if _LOOKUP.search(call[0]):
                first = [text[slice(*s)] for n, s in found if n == 0]
                found = [(n, s) for n, s in found if n]
                yield from ((first[0], [s]) for _, s in found if first)
            yield from held(name, [[s] for _, s in found])
            at = call.end()  # arguments may have names of their own
        elif bare := _BARE.match(text, here):
            reference = _REFERENCE.match(bare[0])
            known = constants.get(reference[1]) if reference else None
            if known or any(c.isdigit() for c in bare[0]):  # else a word of prose or an unknown name
                yield from held(name, [known or [(here, here + len(bare[0].rstrip(".,:!?")))]])
            at = max(bare.end(), at) if known or not reference else at
