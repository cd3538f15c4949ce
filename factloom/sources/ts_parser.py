"""Top-level declarations and call sites of one TypeScript source file. A file that cannot be read raises."""

from __future__ import annotations

from factloom.sources.rust_types import RANK, render, stronger
from factloom.sources.tokens import Cursor, Token, split_top, tokenize

# Names that never become references.
BUILTIN_TYPES = {
    "string", "number", "boolean", "bigint", "symbol", "void", "any", "unknown", "never", "object", "null", "undefined",
    "Date", "RegExp", "Error", "Function", "Object", "String", "Number", "Boolean",
    "Array", "ReadonlyArray", "Set", "ReadonlySet", "Map", "ReadonlyMap", "Record", "Promise", "Partial", "Readonly", "NonNullable", "Required",
}
_NUMBER = {"Array": "many", "ReadonlyArray": "many", "Set": "many", "ReadonlySet": "many", "Map": "many_keyed", "ReadonlyMap": "many_keyed", "Record": "many_keyed"}
_THROUGH = {"Promise", "Partial", "Readonly", "NonNullable", "Required"}
_NULLISH = {"null", "undefined"}
_ACCESS = {"public", "private", "protected"}
_MEMBER_WORDS = _ACCESS | {"static", "readonly", "abstract", "async", "override", "declare", "get", "set", "accessor"}


class TsType:
    def __init__(self, tokens: list[Token]):
        self.refs: dict[str, str] = {}
        self._read([t for t in tokens if t.kind != "doc"], "one")

    def references(self) -> list[dict]:
        return [{"name": n, "cardinality": self.refs[n]} for n in sorted(self.refs)]

    def _read(self, toks: list[Token], card: str) -> None:
        toks = toks[1:] if toks and toks[0].text in ("|", "&") else toks
        if not toks:
            return
        parts = split_top(toks, "|")
        if len(parts) > 1:
            kept = [p for p in parts if not (len(p) == 1 and p[0].text in _NULLISH)]
            card = stronger(card, "optional") if len(kept) < len(parts) else card
            for p in kept:
                self._read(p, card)
            return
        if len(split_top(toks, "&")) > 1:
            return
        if toks[-1].text == "]" and toks[0].text != "[":
            at = len(toks) - 1
            depth = 0
            while at >= 0:
                depth += {"]": 1, "[": -1}.get(toks[at].text, 0)
                if not depth:
                    break
                at -= 1
            if at == len(toks) - 2:
                self._read(toks[:at], stronger(card, "many"))
            return
        if toks[0].text == "readonly":
            return self._read(toks[1:], card)
        if toks[0].text == "(":
            c = Cursor(toks)
            inner = c.group()
            if c.done():
                self._read(inner, card)
            return
        if toks[0].text == "[":
            for p in split_top(Cursor(toks).group()):
                self._read(p, card)
            return
        if toks[0].kind != "id" or toks[0].text in ("typeof", "keyof", "infer", "unique", "new", "asserts"):
            return
        c, name = Cursor(toks), []
        while c.kind() == "id":
            name.append(c.next())
            if not c.take("."):
                break
        full = ".".join(name)
        args = split_top(c.angles()) if c.peek() == "<" else []
        if not c.done():
            return
        if full in _NUMBER:
            for a in args:
                self._read(a, stronger(card, _NUMBER[full]))
        elif full in _THROUGH:
            for a in args:
                self._read(a, card)
        elif full not in BUILTIN_TYPES:
            old = self.refs.get(full, card)
            self.refs[full] = old if RANK[old] >= RANK[card] else card


class TsFile:
    def __init__(self, crate: str, module: str, file: str):
        self.crate, self.module, self.file = crate, module, file
        self.module_id = "::".join(x for x in (crate, module) if x)
        self.types: list[dict] = []
        self.functions: list[dict] = []
        self.calls: list[dict] = []

    def id(self, name: str) -> str:
        return f"{self.module_id}::{name}"

    def read(self, source: str) -> TsFile:
        c = Cursor(tokenize(source, "ts"))
        while not c.done():
            self._statement(c)
        return self

    def _doc(self, c: Cursor) -> str | None:
        doc = None
        while c.i < len(c.t) and c.t[c.i].kind == "doc":
            doc = next((x for x in (y.strip().strip("/* ") for y in c.t[c.i].text.split("\n")) if x), None)
            c.i += 1
        return doc

    def _statement(self, c: Cursor) -> None:
        doc = self._doc(c)
        if c.done():
            return
        at, start = c.i, c.line
        exported = c.take("export")
        c.take("default")
        while c.peek() in ("declare", "abstract") or (c.peek() == "const" and c.peek(1) == "enum"):
            c.next()
        vis = "pub" if exported else "priv"
        word = c.peek()
        while c.peek() == "@":
            c.next()
            c.next()
            while c.take("."):
                c.next()
            if c.peek() == "(":
                c.group()
            word = c.peek()
        if word == "class" and c.peek(1) not in ("(", ".", "="):
            self._class(c, vis, doc, start)
        elif word == "interface" and c.peek(2) in ("{", "<", "extends"):
            self._interface(c, vis, doc, start)
        elif word == "type" and c.peek(2) in ("=", "<"):
            self._alias(c, vis, doc, start)
        elif word == "enum" and c.peek(2) == "{":
            self._enum(c, vis, doc, start)
        elif word == "function" or (word == "async" and c.peek(1) == "function"):
            f = self._function(c, vis, doc, start)
            if f:
                self.functions.append(f)
        else:
            self._rest(c)
        if c.i == at:
            c.next()

    @staticmethod
    def _rest(c: Cursor) -> None:
        """Skip a statement that declares nothing we keep."""
        while not c.done():
            x = c.peek()
            if x in c.PAIRS:
                c.group()
                if x == "{" and c.peek() not in (";", ".", "(", ",", "from", "="):
                    return
                continue
            c.next()
            if x == ";" or c.peek() in ("export", "class", "interface", "enum", "function", "import"):
                return

    def _row(self, name: str, kind: str, vis: str, doc: str | None, start: int, params: list[str]) -> dict:
        row = {"full_path": self.id(name), "name": name, "module": self.module, "module_id": self.module_id, "kind": kind, "visibility": vis, "lifetime_params": [], "type_params": params, "derives": [], "doc_first_line": doc, "unsafe_blocks": 0, "fields": [], "trait_impls": [], "file": self.file, "start_line": start}
        self.types.append(row)
        return row

    @staticmethod
    def _params(c: Cursor) -> list[str]:
        return [p[0].text for p in split_top(c.angles())] if c.peek() == "<" else []

    @staticmethod
    def _heads(tokens: list[Token]) -> list[str]:
        return ["".join(t.text for t in p[: next((i for i, t in enumerate(p) if t.text in ("<", "(")), len(p))]) for p in split_top(tokens)]

    def _class(self, c: Cursor, vis: str, doc: str | None, start: int) -> None:
        c.next()
        name = c.next() if c.peek() not in ("{", "extends") else "default"
        row = self._row(name, "class", vis, doc, start, self._params(c))
        if c.take("extends"):
            row["derives"] += [f"@extends {h}" for h in self._heads(c.until("{", "implements"))]
        if c.take("implements"):
            row["trait_impls"] += self._heads(c.until("{"))
        body = Cursor(c.group())
        row["end_line"] = c.last_line
        while not body.done():
            self._member(body, row, True)

    def _interface(self, c: Cursor, vis: str, doc: str | None, start: int) -> None:
        c.next()
        row = self._row(c.next(), "interface", vis, doc, start, self._params(c))
        if c.take("extends"):
            row["trait_impls"] += self._heads(c.until("{"))
        body = Cursor(c.group())
        row["end_line"] = c.last_line
        while not body.done():
            self._member(body, row, False)

    def _alias(self, c: Cursor, vis: str, doc: str | None, start: int) -> None:
        c.next()
        row = self._row(c.next(), "type_alias", vis, doc, start, self._params(c))
        c.want("=")
        depth_line = c.line
        while not c.done() and c.peek() != ";":
            x = c.peek()
            if x in ("export", "class", "interface", "enum", "function", "const", "let", "import") and c.line > depth_line:
                break
            if x == "type" and c.line > depth_line and c.peek(2) in ("=", "<"):
                break
            c.group() if x in c.PAIRS else c.next()
        c.take(";")
        row["end_line"] = c.last_line

    def _enum(self, c: Cursor, vis: str, doc: str | None, start: int) -> None:
        c.next()
        row = self._row(c.next(), "enum", vis, doc, start, [])
        for p in split_top(c.group()):
            p = [t for t in p if t.kind != "doc"]
            row["fields"].append({"name": p[0].text.strip("\"'"), "line": p[0].line, "ty_text": "()", "ownership": "primitive", "refs": [], "lifetimes": []})
        row["end_line"] = c.last_line

    def _member(self, c: Cursor, row: dict, is_class: bool) -> None:
        doc = self._doc(c)
        if c.done():
            return
        while c.peek() == "@":
            c.next()
            c.next()
            if c.peek() == "(":
                c.group()
        if c.take(";") or c.take(","):
            return
        start, words = c.line, []
        while c.peek() in _MEMBER_WORDS and c.peek(1) not in ("(", ":", "?", "=", ";", "!", "<"):
            words.append(c.next())
        if words[-1:] == ["static"] and c.peek() == "{":
            c.group()
            return
        c.take("*")
        vis = "priv" if "private" in words else "protected" if "protected" in words else "pub"
        if c.peek() == "[":
            c.group()
            name = "<computed>"
        elif c.peek() in ("(", "<"):
            name = "<call>"
        elif c.peek() == "#":
            c.next()
            name, vis = "#" + c.next(), "priv"
        else:
            name = c.next().strip("\"'")
        optional = c.take("?")
        c.take("!")
        if c.peek() in ("(", "<"):
            f = self._callable(c, name, vis, doc, start, "type", row["full_path"], "async" in words)
            if not name.startswith("<"):
                self.functions.append(f)
                if name == "constructor":
                    for p in f.pop("_promoted"):
                        row["fields"].append(p)
            f.pop("_promoted", None)
            return
        ty: list[Token] = []
        if c.take(":"):
            ty = self._type_until(c, ("=", ";", ","))
        if c.take("="):
            self._type_until(c, (";",))
        c.take(";") or c.take(",")
        if not name.startswith("<"):
            row["fields"].append(self._field(name, ty, optional, start, "owned"))

    @staticmethod
    def _type_until(c: Cursor, stops: tuple[str, ...]) -> list[Token]:
        """A type or value, which a line end closes where nothing is open and the next line starts a new member."""
        start, depth = c.i, 0
        last = c.line
        while not c.done():
            x = c.peek()
            if depth <= 0 and x in stops:
                break
            prev = c.t[c.i - 1].text if c.i > start else ""
            if c.i > start and c.line > last and depth <= 0 and prev not in ("|", "&", "=>", "=", ":", ",", ".", "?", "+", "(", "||", "&&") and x not in ("|", "&", ".", "?", ":", "=>", "+", "||", "&&", "?."):
                break
            if x in c.PAIRS:
                c.group()
            else:
                c.next()
                depth += {"<": 1, ">": -1}.get(x, 0)
            last = c.last_line
        return c.t[start : c.i]

    @staticmethod
    def _field(name: str, ty: list[Token], optional: bool, line: int, ownership: str) -> dict:
        refs = TsType(ty).references()
        if optional:
            refs = [{"name": r["name"], "cardinality": stronger(r["cardinality"], "optional")} for r in refs]
        return {"name": name, "line": line, "ty_text": render(ty), "ownership": ownership, "refs": refs, "lifetimes": []}

    def _function(self, c: Cursor, vis: str, doc: str | None, start: int) -> dict | None:
        is_async = c.take("async")
        c.next()
        c.take("*")
        name = c.next() if c.peek() not in ("(", "<") else "default"
        f = self._callable(c, name, vis, doc, start, "module", self.module_id, is_async)
        f.pop("_promoted")
        return f

    def _callable(self, c: Cursor, name: str, vis: str, doc: str | None, start: int, owner_kind: str, owner: str, is_async: bool) -> dict:
        self._params(c)
        params, promoted = [], []
        for part in split_top(c.group()):
            p = Cursor(part)
            while p.peek() == "@":
                p.next()
                p.next()
                if p.peek() == "(":
                    p.group()
            words = []
            while p.peek() in _ACCESS | {"readonly", "override"} and p.peek(1) not in (":", "?", "=", ","):
                words.append(p.next())
            p.take("...")
            if p.peek() in ("{", "["):
                p.group()
                pname = "_"
            else:
                pname = p.next()
            opt = p.take("?")
            ty = p.until("=") if p.take(":") else []
            if pname == "this":
                continue
            params.append(self._field(pname, ty, opt, start, "owned"))
            if words:
                promoted.append(self._field(pname, ty, opt, start, "owned"))
        ret: list[Token] = []
        if c.take(":"):
            ret = self._return_type(c)
        if c.peek() == "{":
            body = c.group()
            caller = f"{owner}::{name}"
            self._calls(caller, owner if owner_kind == "type" else None, body)
        else:
            c.take(";") or c.take(",")
        return {"owner_kind": owner_kind, "owner": owner, "module": self.module, "name": name, "impl_trait": None, "visibility": vis, "self_kind": "none" if owner_kind == "module" else "ref", "is_unsafe": False, "is_const": False, "is_async": bool(is_async), "lifetime_params": [], "params": params, "return_ty_text": render(ret), "return_ownership": "owned", "return_refs": TsType(ret).references(), "lifetime_flows_through": False, "unsafe_blocks": 0, "doc_first_line": doc, "file": self.file, "start_line": start, "end_line": c.last_line, "_promoted": promoted}

    @staticmethod
    def _return_type(c: Cursor) -> list[Token]:
        start = c.i
        first, last = True, c.line
        while not c.done():
            x = c.peek()
            if x in (";", ",") or (x == "{" and not first and c.t[c.i - 1].text not in ("|", "&", "=>", "is")):
                break
            if not first and c.line > last and c.t[c.i - 1].text not in ("|", "&", "=>") and x not in ("|", "&", "{"):
                break
            if x == "<":
                c.angles()
            elif x in c.PAIRS:
                c.group()
            else:
                c.next()
            first, last = False, c.last_line
        return c.t[start : c.i]

    def _calls(self, caller: str, owner: str | None, body: list[Token]) -> None:
        """Call sites: ``f()``, ``this.m()``, ``Type.m()``, ``x.m()``, ``super.m()`` and ``new T()``; computed ones are skipped."""
        toks = [t for t in body if t.kind != "doc"]
        skip = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "super", "import", "new", "in", "of"}
        for i, t in enumerate(toks):
            if t.kind != "id" or i + 1 >= len(toks):
                continue
            j = i + 1
            if toks[j].text == "<":
                c = Cursor(toks[j:])
                try:
                    c.angles()
                except ValueError:
                    continue
                j += c.i
                if j >= len(toks) or toks[j].text != "(":
                    continue
            before = toks[i - 1].text if i else ""
            if toks[j].text != "(":
                continue
            c = Cursor(toks[j:])
            c.group()
            end = toks[j + c.i - 1].line
            site = {"caller": caller, "callsite_start_line": t.line, "callsite_end_line": end, "hint": None}
            if before == "new":
                self.calls.append(site | {"kind": "associated_function", "name": "constructor", "type_hint": t.text, "origin": f"new {t.text}"})
            elif before in (".", "?."):
                target = toks[i - 2].text if i >= 2 else ""
                lone = i < 3 or toks[i - 3].text not in (".", "?.")
                if target == "this" and lone:
                    self.calls.append(site | {"kind": "method", "name": t.text, "hint": owner, "type_hint": None, "origin": f"this.{t.text}"})
                elif target == "super":
                    self.calls.append(site | {"kind": "method", "name": t.text, "type_hint": None, "origin": f"super.{t.text}"})
                elif i >= 2 and toks[i - 2].kind == "id" and lone:
                    upper = target[:1].isupper()
                    self.calls.append(site | {"kind": "associated_function" if upper else "method", "name": t.text, "type_hint": target if upper else None, "origin": f"{target}.{t.text}"})
                else:
                    self.calls.append(site | {"kind": "method", "name": t.text, "type_hint": None, "origin": f".{t.text}"})
            elif t.text not in skip and before != "function":
                nxt = toks[j + c.i].text if j + c.i < len(toks) else ""
                if not (nxt == "{" and before in ("{", "}", ",", ";", "async", "get", "set", "")):  # a method of an object literal
                    self.calls.append(site | {"kind": "function", "name": t.text, "hint": self.module_id, "type_hint": None, "origin": t.text})


def parse_ts(crate: str, module: str, file: str, source: str) -> TsFile:
    return TsFile(crate, module, file).read(source)
