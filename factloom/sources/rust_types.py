"""Printed form and classification of Rust type expressions."""

from __future__ import annotations

from factloom.sources.tokens import Cursor, Token, split_top, tokenize

# Names that are not surfaced as references, and what containers say about number.
PRIMITIVES = {"bool", "char", "str", "String", "u8", "u16", "u32", "u64", "u128", "usize", "i8", "i16", "i32", "i64", "i128", "isize", "f32", "f64", "()", "!"}
OWNING_CONTAINERS = {"Vec", "VecDeque", "HashMap", "HashSet", "BTreeMap", "BTreeSet", "LinkedList", "Box", "Rc", "Arc", "Cell", "RefCell", "Mutex", "RwLock", "Option", "Result", "Cow", "PhantomData"}
INDIRECTIONS = {"NonNull", "ManuallyDrop", "MaybeUninit"}
CONTAINER_CARDINALITY = {"Option": "optional", "Vec": "many", "VecDeque": "many", "BTreeSet": "many", "HashSet": "many", "LinkedList": "many", "BTreeMap": "many_keyed", "HashMap": "many_keyed"}

RANK = {"one": 0, "optional": 1, "many": 2, "many_keyed": 3}
_TIGHT_BEFORE = {",", ";", ")", "]", ">", "::", "<", ":", ".", "?"}
_TIGHT_AFTER = {"(", "[", "<", "::", "&", "*", "!", "'", "."}


def stronger(a: str, b: str) -> str:
    return a if RANK[a] >= RANK[b] else b


def render(tokens: list[Token]) -> str:
    """One line with the usual spacing."""
    out = ""
    last = ""
    for t in tokens:
        if t.kind == "doc":
            continue
        x = t.text
        if out and x not in _TIGHT_BEFORE and last not in _TIGHT_AFTER and not (x in ("(", "[") and last not in (",", ";", "->", "+", "=", "mut", "dyn", "impl", "const", ":")):
            out += " "
        out += x
        last = x
    return out


class Classified:
    """Ownership, references with cardinality, lifetimes of one type expression."""

    def __init__(self, tokens: list[Token]):
        self.refs: dict[str, str] = {}
        self.lifetimes: set[str] = set()
        self.ownership = self._read([t for t in tokens if t.kind != "doc"], True, "one")

    def references(self) -> list[dict]:
        return [{"name": n, "cardinality": self.refs[n]} for n in sorted(self.refs) if n not in PRIMITIVES]

    def _note(self, name: str, card: str) -> None:
        self.refs[name] = stronger(self.refs.get(name, card), card)

    def _read(self, toks: list[Token], top: bool, card: str) -> str:
        if not toks:
            return "other"
        head = toks[0].text
        if head in ("&", "&&"):
            rest = toks[1:]
            if rest and rest[0].kind == "life":
                self.lifetimes.add(rest[0].text[1:])
                rest = rest[1:]
            mutable = bool(rest) and rest[0].text == "mut"
            self._read(rest[1:] if mutable else rest, False, card)
            return "borrow_mut" if mutable and head == "&" else "borrow_immut"
        if head == "*":
            self._read(toks[2:], False, card)
            return "indirection"
        if head in ("dyn", "impl", "fn", "for", "unsafe", "extern"):
            return self._harvest(toks, card)
        if head == "(":
            inner = Cursor(toks).group()
            parts = split_top(inner)
            if len(parts) == 1 and inner and inner[-1].text != ",":
                return self._read(parts[0], top, card)
            for p in parts:
                self._read(p, False, card)
            return "primitive" if top and not parts else "owned"
        if head == "[":
            self._read(split_top(Cursor(toks).group(), ";")[0], False, stronger(card, "many"))
            return "owned"
        if head == "<" or toks[0].kind == "id":
            return self._path(toks, top, card)
        return "other"

    def _path(self, toks: list[Token], top: bool, card: str) -> str:
        c, name, args = Cursor(toks), "", []
        if c.peek() == "<":
            c.angles()
            c.take("::")
        while not c.done():
            if c.peek() == "::":
                c.next()
                if c.peek() == "<":
                    args = c.angles()
                continue
            if c.kind() != "id":
                break
            name, args = c.next(), []
            if c.peek() == "!":
                return "other"
            if c.peek() == "<":
                args = c.angles()
            elif c.peek() == "(":
                c.group()
                break
        inner = stronger(card, CONTAINER_CARDINALITY.get(name, "one"))
        for a in split_top(args):
            if a[0].kind == "life" and len(a) == 1:
                self.lifetimes.add(a[0].text[1:])
            elif not any(t.text == "=" for t in a) and a[0].kind not in ("num", "lit") and a[0].text != "{":
                self._read(a, False, inner)
        if name == "_":
            return "other"
        if name == "Self":
            return "owned"
        if name in PRIMITIVES:
            return "primitive" if top else "owned"
        if name in INDIRECTIONS:
            return "indirection" if top else "owned"
        if name not in OWNING_CONTAINERS:
            self._note(name, card)
        return "owned"

    def _harvest(self, toks: list[Token], card: str) -> str:
        for t in toks:
            if t.kind == "id" and t.text[0].isupper() and t.text not in PRIMITIVES | OWNING_CONTAINERS | INDIRECTIONS:
                self._note(t.text, card)
        return "other"


def classify_text(text: str) -> tuple[str, list[dict], list[str]]:
    c = Classified(tokenize(text, "rust"))
    return c.ownership, c.references(), sorted(c.lifetimes)
