"""Items of one Rust source file as plain rows. A file that cannot be read gives no rows.

Macro bodies are not expanded, and calls inside macro arguments are not seen.
"""

from __future__ import annotations

from factloom.sources.rust_types import Classified, render
from factloom.sources.tokens import Cursor, Token, split_top, tokenize

_MODIFIERS = {"const", "async", "unsafe", "extern", "default", "safe"}
_KEYWORDS = {"if", "while", "match", "for", "loop", "return", "let", "mut", "ref", "move", "in", "as", "else", "break", "continue", "fn", "unsafe", "async", "await", "where", "impl", "dyn", "struct", "enum", "use", "pub", "mod", "static", "const", "type", "trait", "union"}


def _typed(tokens: list[Token]) -> dict:
    c = Classified(tokens)
    return {"ty_text": render(tokens), "ownership": c.ownership, "refs": c.references(), "lifetimes": sorted(c.lifetimes)}


class RustFile:
    def __init__(self, crate: str, module: str, file: str):
        self.crate, self.root, self.file = crate, module, file
        self.types: list[dict] = []
        self.functions: list[dict] = []
        self.impls: list[dict] = []
        self.exports: list[dict] = []
        self.modules: list[dict] = []
        self.calls: list[dict] = []

    def id(self, module: str, name: str) -> str:
        return "::".join(x for x in (self.crate, module, name) if x)

    def read(self, source: str) -> RustFile:
        self._module(self.root, Cursor(tokenize(source, "rust")))
        return self

    # items -------------------------------------------------------------

    def _module(self, module: str, c: Cursor) -> None:
        self.modules.append({"module": module, "module_id": self.id(module, ""), "file": self.file})
        while not c.done():
            self._item(module, c)

    def _meta(self, c: Cursor) -> tuple[list[str], str | None]:
        derives, doc = [], None
        while c.i < len(c.t):
            t = c.t[c.i]
            if t.kind == "doc":
                c.i += 1
                if not t.text.startswith("//!") and doc is None:
                    lines = [x.strip().lstrip("/*").rstrip("*/").strip(" *") for x in t.text.split("\n")]
                    doc = next((x for x in lines if x), None)
            elif t.text == "#":
                c.i += 1
                c.take("!")
                inner = c.group()
                if inner and inner[0].text == "derive":
                    for p in split_top(Cursor(inner[1:]).group()):
                        derives.append(p[-1].text)
            else:
                break
        return derives, doc

    @staticmethod
    def _visibility(c: Cursor) -> str:
        if not c.take("pub"):
            return "priv"
        if c.peek() == "(" and c.peek(1) in ("crate", "super", "self", "in"):
            inner = c.group()
            return "pub(" + render([t for t in inner if t.text != "in"]) + ")"
        return "pub"

    @staticmethod
    def _generics(c: Cursor) -> tuple[list[str], list[str]]:
        lifetimes, types = [], []
        if c.peek() == "<":
            for p in split_top(c.angles()):
                if p[0].kind == "life":
                    lifetimes.append(p[0].text[1:])
                else:
                    types.append(p[1].text if p[0].text == "const" else p[0].text)
        return lifetimes, types

    def _item(self, module: str, c: Cursor) -> None:
        derives, doc = self._meta(c)
        if c.done():
            return
        start = c.line
        vis = self._visibility(c)
        word = c.peek()
        mods = set()
        at = c.i
        while c.peek() in _MODIFIERS and (c.peek(1) in _MODIFIERS | {"fn", "impl", "trait", "mod"} or c.peek(1).startswith('"')):
            mods.add(c.next())
            if c.peek().startswith('"'):
                c.next()
        if c.peek() == "fn":
            self.functions.append(self._function(module, c, vis, mods, doc, "module", self.id(module, ""), None))
            return
        word = c.peek()
        if word in ("struct", "enum", "trait", "type") or (word == "union" and c.peek(2) in ("{", "<", "where")):
            self._type(module, c, word, vis, derives, doc, start)
        elif word == "impl":
            self._impl(module, c)
        elif word == "mod":
            c.next()
            name = c.next()
            if c.peek() == "{":
                self._module("::".join(x for x in (module, name) if x), Cursor(c.group()))
            else:
                c.take(";")
        elif word == "use":
            c.next()
            line = c.line
            tree = c.until(";")
            c.take(";")
            if vis == "pub":
                for path, name in self._use(tree, []):
                    self.exports.append({"module_id": self.id(module, ""), "exposed_name": name, "hint": "::".join(path), "visibility": vis, "line": line, "file": self.file})
        elif word == "macro_rules" or c.peek(1) == "!":
            while not c.done() and c.peek() not in ("{", "(", "["):
                c.next()
            if not c.done():
                brace = c.peek() == "{"
                c.group()
                if not brace:
                    c.take(";")
        elif word == "extern" and c.peek(1) != "crate":
            while not c.done() and c.peek() not in ("{", ";"):
                c.next()
            c.group() if c.peek() == "{" else c.take(";")
        else:
            c.i = at if not mods else c.i
            c.until(";", "{")
            if c.peek() == "{":
                c.group()
            c.take(";")
            if c.i == at:
                c.next()

    def _use(self, toks: list[Token], prefix: list[str]):
        c = Cursor(toks)
        path = list(prefix)
        while not c.done():
            x = c.next()
            if x == "::":
                continue
            if x == "{":
                c.i -= 1
                for part in split_top(c.group()):
                    yield from self._use(part, path)
                return
            if x == "*":
                return
            if x == "as":
                name = c.next()
                if name != "_":
                    yield path, name
                return
            path = path if x == "self" and path else [*path, x]
        if path:
            yield path, path[-1]

    def _type(self, module: str, c: Cursor, word: str, vis: str, derives: list[str], doc: str | None, start: int) -> None:
        c.next()
        name = c.next()
        lifetimes, params = self._generics(c)
        kind = "type_alias" if word == "type" else word
        full = self.id(module, name)
        row = {"full_path": full, "name": name, "module": module, "module_id": self.id(module, ""), "kind": kind, "visibility": vis, "lifetime_params": lifetimes, "type_params": params, "derives": derives, "doc_first_line": doc, "unsafe_blocks": 0, "fields": [], "trait_impls": [], "file": self.file, "start_line": start}
        self.types.append(row)
        if kind == "type_alias":
            c.until("=", ";")
            if c.take("="):
                row["fields"].append({"name": "<alias>"} | _typed(c.until(";", "where")))
            c.until(";")
            c.take(";")
        elif kind == "trait":
            c.until("{", ";")
            if c.peek() == "{":
                self._members(module, Cursor(c.group()), full, None, row)
        else:
            if c.peek() == "where":
                c.until("{", ";")
            if c.peek() == "{":
                body = c.group()
                row["fields"] += self._variants(body) if kind == "enum" else self._named(body, "")
            elif c.peek() == "(":
                row["fields"] += self._tuple(c.group(), "")
                c.until(";")
            c.take(";")
        row["end_line"] = c.last_line

    def _named(self, body: list[Token], prefix: str) -> list[dict]:
        out = []
        for part in split_top(body):
            c = Cursor(part)
            self._meta(c)
            if c.done():
                continue
            line = c.line
            self._visibility(c)
            name = c.next()
            c.want(":")
            out.append({"name": prefix + name, "line": line} | _typed(part[c.i :]))
        return out

    def _tuple(self, body: list[Token], prefix: str) -> list[dict]:
        out = []
        for k, part in enumerate(split_top(body)):
            c = Cursor(part)
            self._meta(c)
            line = c.line
            self._visibility(c)
            out.append({"name": f"{prefix}.{k}", "line": line} | _typed(part[c.i :]))
        return out

    def _variants(self, body: list[Token]) -> list[dict]:
        out = []
        for part in split_top(body):
            c = Cursor(part)
            self._meta(c)
            if c.done():
                continue
            line = c.line
            name = c.next()
            if c.peek() == "{":
                out += self._named(c.group(), name + "::")
            elif c.peek() == "(":
                out += self._tuple(c.group(), name + "::")
            else:
                out.append({"name": name, "line": line, "ty_text": "()", "ownership": "primitive", "refs": [], "lifetimes": []})
        return out

    def _impl(self, module: str, c: Cursor) -> None:
        c.want("impl")
        if c.peek() == "<":
            c.angles()
        c.take("!")
        head = c.until("for", "where", "{")
        trait, owner = None, head
        if c.take("for"):
            trait, owner = head, c.until("where", "{")
        if c.peek() == "where":
            c.until("{")
        body = Cursor(c.group())
        # the last name of the owner's path, references and arguments left aside
        o = Cursor([t for t in owner if t.text not in ("&", "mut") and t.kind != "life"])
        name = ""
        while not o.done():
            if o.peek() == "<":
                o.angles()
                continue
            x = o.next()
            if x.isidentifier():
                name = x
        short = None
        if trait is not None:
            p = Cursor(trait)
            while not p.done():
                if p.peek() == "<":
                    p.angles()
                    continue
                x = p.next()
                if x.isidentifier():
                    short = x
        row = {"module": module, "module_id": self.id(module, ""), "type_name": name, "impl_trait": short, "unsafe_blocks": 0, "methods": 0}
        self.impls.append(row)
        self._members(module, body, self.id(module, name), short, row)

    def _members(self, module: str, c: Cursor, owner: str, trait: str | None, row: dict) -> None:
        while not c.done():
            _, doc = self._meta(c)
            if c.done():
                break
            vis = self._visibility(c)
            mods = set()
            while c.peek() in _MODIFIERS and (c.peek(1) in _MODIFIERS | {"fn"} or c.peek(1).startswith('"')):
                mods.add(c.next())
                if c.peek().startswith('"'):
                    c.next()
            if c.peek() == "fn":
                f = self._function(module, c, "pub" if row.get("kind") == "trait" else vis, mods, doc, "type", owner, trait)
                f["impl_index"] = len(self.impls) - 1 if "kind" not in row else -1
                row["unsafe_blocks"] += f["unsafe_blocks"]
                self.functions.append(f)
            else:
                at = c.i
                c.until(";", "{")
                if c.peek() == "{":
                    c.group()
                c.take(";")
                if c.i == at:
                    c.next()

    def _function(self, module: str, c: Cursor, vis: str, mods: set[str], doc: str | None, owner_kind: str, owner: str, trait: str | None) -> dict:
        start = c.line
        c.want("fn")
        name = c.next()
        lifetimes, _ = self._generics(c)
        self_kind, params, inputs = "none", [], set()
        names = set()
        for k, part in enumerate(split_top(c.group())):
            p = Cursor(part)
            self._meta(p)
            part = part[p.i :]
            words = [t.text for t in part]
            if k == 0 and "self" in words[:4] and (":" not in words or words.index("self") < words.index(":")):
                self_kind = "ref_mut" if words[0] == "&" and "mut" in words else "ref" if words[0] == "&" else "by_value"
                inputs |= {t.text[1:] for t in part if t.kind == "life"}
                continue
            q = Cursor(part)
            pattern = q.until(":")
            q.want(":")
            typed = _typed(part[q.i :])
            plain = [t.text for t in pattern if t.text not in ("mut", "ref")]
            params.append({"name": plain[0] if len(plain) == 1 and plain[0].isidentifier() else "_"} | typed)
            names |= {t.text for t in pattern if t.kind == "id"}
            inputs |= set(typed["lifetimes"])
        ret = {"ty_text": "", "ownership": "primitive", "refs": [], "lifetimes": []}
        if c.take("->"):
            ret = _typed(c.until("{", ";", "where"))
        if c.peek() == "where":
            c.until("{", ";")
        unsafe = 0
        if c.peek() == "{":
            body = c.group()
            unsafe = self._unsafe(body)
            self._calls(module, self.id(module, name) if owner_kind == "module" else f"{owner}::{name}", owner if owner_kind == "type" else None, body, names)
        else:
            c.take(";")
        return {"owner_kind": owner_kind, "owner": owner, "module": module, "name": name, "impl_trait": trait, "visibility": vis, "self_kind": self_kind, "is_unsafe": "unsafe" in mods, "is_const": "const" in mods, "is_async": "async" in mods, "lifetime_params": lifetimes, "params": params, "return_ty_text": ret["ty_text"], "return_ownership": ret["ownership"], "return_refs": ret["refs"], "lifetime_flows_through": bool(set(ret["lifetimes"]) & inputs), "unsafe_blocks": unsafe, "doc_first_line": doc, "file": self.file, "start_line": start, "end_line": c.last_line}

    @staticmethod
    def _unsafe(body: list[Token]) -> int:
        c, n = Cursor(body), 0
        while not c.done():
            if c.next() == "unsafe" and c.peek() == "{":
                c.group()
                n += 1
        return n

    def _calls(self, module: str, caller: str, owner: str | None, body: list[Token], bound: set[str]) -> None:
        """Call sites of a body; names bound before a call hide functions of that name."""
        toks = [t for t in body if t.kind != "doc"]
        bound = set(bound)
        pending: list[tuple[int, str]] = []
        i = 0
        while i < len(toks):
            t = toks[i]
            if t.text == "let":
                j, pattern = i + 1, []
                while j < len(toks) and toks[j].text not in ("=", ";", ":", "else"):
                    if toks[j].kind == "id" and toks[j].text[0].islower() and toks[j].text not in ("mut", "ref"):
                        pattern.append(toks[j].text)
                    j += 1
                depth, k = 0, j
                while k < len(toks) and (depth or toks[k].text != ";"):
                    depth += {"{": 1, "(": 1, "[": 1, "}": -1, ")": -1, "]": -1}.get(toks[k].text, 0)
                    if depth < 0:
                        break
                    k += 1
                pending += [(k, p) for p in pattern]
                i = j
                continue
            for k, p in [x for x in pending if x[0] <= i]:
                bound.add(p)
                pending.remove((k, p))
            if t.text == "fn" and i + 2 < len(toks) and toks[i + 1].kind == "id":
                c = Cursor(toks[i:])
                c.until("{", ";")
                if c.peek() == "{":
                    c.group()
                i += max(1, c.i)
                continue
            if t.text == "." and i + 1 < len(toks) and toks[i + 1].kind == "id":
                j = i + 2
                if j + 1 < len(toks) and toks[j].text == "::" and toks[j + 1].text == "<":
                    c = Cursor(toks[j + 1 :])
                    c.angles()
                    j += 1 + c.i
                if j < len(toks) and toks[j].text == "(":
                    on_self = i > 0 and toks[i - 1].text == "self" and (i < 2 or toks[i - 2].text != ".")
                    self._call(caller, "method", toks[i + 1].text, owner if on_self else None, module, owner, ("self." if on_self else ".") + toks[i + 1].text, toks[i + 1].line, toks, j)
                i += 2
                continue
            if t.kind == "id" and t.text not in _KEYWORDS and (i == 0 or toks[i - 1].text not in (".", "fn", "::")):
                path, j = [t.text], i + 1
                while j + 1 < len(toks) and toks[j].text == "::":
                    if toks[j + 1].text == "<":
                        c = Cursor(toks[j + 1 :])
                        c.angles()
                        j += 1 + c.i
                    elif toks[j + 1].kind == "id":
                        path.append(toks[j + 1].text)
                        j += 2
                    else:
                        break
                if j + 1 < len(toks) and toks[j].text == "!" and (toks[j + 1].text in ("(", "[", "{") or path == ["macro_rules"]):
                    c = Cursor(toks[j + 1 :])  # what stands inside a macro call is no code yet
                    if path == ["macro_rules"]:
                        c.next()
                    c.group()
                    i = j + 1 + c.i
                    continue
                if j < len(toks) and toks[j].text == "(" and (path[-1][0].islower() or path[-1][0] == "_"):
                    if not (len(path) == 1 and path[0] in bound):
                        kind = "associated_function" if len(path) > 1 and (path[-2][0].isupper()) else "function"
                        self._call(caller, kind, "::".join(path), None, module, owner, "::".join(path), t.line, toks, j)
                i = max(j, i + 1)
                continue
            i += 1

    def _call(self, caller: str, kind: str, path: str, self_type: str | None, module: str, owner: str | None, origin: str, line: int, toks: list[Token], at: int) -> None:
        c = Cursor(toks[at:])
        c.group()
        self.calls.append({"caller": caller, "kind": kind, "path": path, "name": path.split("::")[-1], "self_type": self_type, "owner_type": owner, "module_id": self.id(module, ""), "origin": origin, "callsite_start_line": line, "callsite_end_line": toks[at + c.i - 1].line})


def parse_rust(crate: str, module: str, file: str, source: str) -> RustFile | None:
    try:
        return RustFile(crate, module, file).read(source)
    except (ValueError, IndexError, KeyError):
        return None
