"""A small tokenizer shared by the source parsers: kind, text, line. Comments vanish, doc comments stay."""

from __future__ import annotations

import re
from dataclasses import dataclass

_RUST = re.compile(
    r"""(?P<ws>\s+)|(?P<doc>///(?!/)[^\n]*|//![^\n]*|/\*\*(?!\*|/).*?\*/)|(?P<line>//[^\n]*)|(?P<block>/\*)
    |(?P<raw>b?r(?P<h>\#*)".*?"(?P=h))|(?P<str>[bc]?"(?:\\.|[^"\\])*")|(?P<chr>b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])')|(?P<life>'[A-Za-z_]\w*)
    |(?P<id>(?:r\#)?[A-Za-z_]\w*)|(?P<num>\d[\w.]*?(?=\.\.|[^\w.]|\.(?!\d)|$)|\d\w*)|(?P<op>::|->|=>|\.\.=|\.\.\.|\.\.|&&|\|\||[-+*/%^&|<>=!]=|[^\w\s])""",
    re.X | re.S,
)
_TS = re.compile(
    r"""(?P<ws>\s+)|(?P<doc>/\*\*(?!/).*?\*/)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)
    |(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<tpl>`)|(?P<id>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)
    |(?P<op>=>|\.\.\.|\?\.|\?\?|===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|[^\w\s])""",
    re.X | re.S,
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    line: int


def _skip_nested(src: str, at: int) -> int:
    depth, i = 1, at + 2
    while i < len(src) and depth:
        if src.startswith("/*", i):
            depth, i = depth + 1, i + 2
        elif src.startswith("*/", i):
            depth, i = depth - 1, i + 2
        else:
            i += 1
    return i


def _skip_template(src: str, at: int) -> int:
    """End of a template literal that starts at ``at``, inner expressions included."""
    i = at + 1
    while i < len(src):
        if src[i] == "\\":
            i += 2
        elif src[i] == "`":
            return i + 1
        elif src.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(src) and depth:
                if src[i] == "`":
                    i = _skip_template(src, i)
                    continue
                depth += {"{": 1, "}": -1}.get(src[i], 0)
                i += 1
        else:
            i += 1
    return i


def tokenize(src: str, language: str) -> list[Token]:
    pattern = _RUST if language == "rust" else _TS
    out, at, line = [], 0, 1
    while at < len(src):
        m = pattern.match(src, at)
        if not m:
            raise ValueError(f"line {line}: cannot read {src[at : at + 10]!r}")
        kind, end = m.lastgroup, m.end()
        if kind == "h":
            kind = "raw"
        if language == "rust" and kind == "block":
            end = _skip_nested(src, at)
        elif kind == "tpl":
            end, kind = _skip_template(src, at), "str"
        elif language != "rust" and kind == "op" and m.group() == "/" and (not out or out[-1].text in ("(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "&&", "||", "return", "==", "===")):
            r = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(src, at)
            if r:
                end, kind = r.end(), "str"
        text = src[at:end]
        if kind in ("raw", "str", "chr"):
            out.append(Token("lit", text, line))
        elif kind not in ("ws", "line", "block"):
            out.append(Token(kind, text, line))
        line += text.count("\n")
        at = end
    return out


class Cursor:
    """Reading position over tokens; doc comments are taken only when asked for."""

    PAIRS = {"(": ")", "[": "]", "{": "}"}

    def __init__(self, tokens: list[Token]):
        self.t, self.i = tokens, 0

    def _at(self) -> int:
        j = self.i
        while j < len(self.t) and self.t[j].kind == "doc":
            j += 1
        return j

    def peek(self, ahead: int = 0) -> str:
        j = self._at()
        while ahead and j < len(self.t):
            j += 1
            while j < len(self.t) and self.t[j].kind == "doc":
                j += 1
            ahead -= 1
        return self.t[j].text if j < len(self.t) else ""

    def kind(self) -> str:
        j = self._at()
        return self.t[j].kind if j < len(self.t) else ""

    @property
    def line(self) -> int:
        j = self._at()
        return self.t[j].line if j < len(self.t) else (self.t[-1].line if self.t else 1)

    @property
    def last_line(self) -> int:
        return self.t[max(0, self.i - 1)].line if self.t else 1

    def next(self) -> str:
        self.i = self._at()
        if self.i >= len(self.t):
            raise ValueError("unexpected end of file")
        self.i += 1
        return self.t[self.i - 1].text

    def take(self, text: str) -> bool:
        if self.peek() == text:
            self.next()
            return True
        return False

    def want(self, text: str) -> None:
        if not self.take(text):
            raise ValueError(f"line {self.line}: expected {text!r}, found {self.peek()!r}")

    def done(self) -> bool:
        return self._at() >= len(self.t)

    def group(self) -> list[Token]:
        """The tokens inside a bracket that starts here."""
        open_ = self.next()
        stack, start = [self.PAIRS[open_]], self.i
        while stack:
            if self.i >= len(self.t):
                raise ValueError("unclosed bracket")
            x = self.t[self.i]
            self.i += 1
            if x.kind == "op":
                if x.text in self.PAIRS:
                    stack.append(self.PAIRS[x.text])
                elif x.text in ")]}":
                    if x.text != stack.pop():
                        raise ValueError(f"line {x.line}: brackets do not match")
        return self.t[start : self.i - 1]

    def angles(self) -> list[Token]:
        """The tokens inside ``<`` … ``>`` that starts here; arrows do not close it."""
        self.want("<")
        depth, start = 1, self.i
        while depth:
            if self.i >= len(self.t):
                raise ValueError("unclosed angle")
            x = self.peek()
            if x in self.PAIRS:
                self.group()
                continue
            self.i = self._at() + 1
            depth += {"<": 1, ">": -1, ">=": -1}.get(x, 0)
        return self.t[start : self.i - 1]

    def until(self, *stops: str) -> list[Token]:
        """Tokens up to one of ``stops`` outside all brackets and angles."""
        start, depth = self.i, 0
        while self.i < len(self.t):
            x = self.peek()
            if depth <= 0 and x in stops:
                break
            if x in self.PAIRS:
                self.group()
                continue
            if not x:
                break
            self.i = self._at() + 1
            depth += {"<": 1, ">": -1}.get(x, 0)
        return self.t[start : self.i]


def split_top(tokens: list[Token], by: str = ",") -> list[list[Token]]:
    """Parts of a token list between separators outside brackets and angles."""
    c, out = Cursor(tokens), []
    while not c.done():
        out.append(c.until(by))
        if not c.take(by):
            break
    return [p for p in out if p]
