"""Source trees to facts: parsers, discovery, resolution and edges."""

import pytest

from factloom.sources.rust_parser import parse_rust
from factloom.sources.rust_types import classify_text
from factloom.sources.ts_parser import parse_ts

LIB = """
//! crate docs
pub mod parts;
pub use self::parts::{Piston, Valve as Lid};
pub use parts::*;
/// An engine.
#[derive(Debug, Clone)]
pub struct Engine<'a, T: Clone> { pub pistons: Vec<parts::Piston>, name: &'a str, map: std::collections::HashMap<String, T>, lid: Option<Valve> }
pub enum Shape { Dot, Line(f64, Point), Poly { pts: Vec<Point> } }
pub struct Point;
pub trait Run { fn go(&self) -> u8; }
impl Run for Point { fn go(&self) -> u8 { unsafe { raw() } } }
impl<'a, T: Clone> Engine<'a, T> {
    pub fn new(name: &'a str) -> Self { Self::build(name) }
    fn build(n: &'a str) -> Engine<'a, T> { parts::make(n); helper(); self.spin() }
    fn spin(&self) { let helper = |x| x; helper(1); self.go_on() }
    fn go_on(&self) {}
}
impl Display for Missing { fn fmt(&self) {} }
pub fn helper() -> Point { Point }
fn raw() -> u8 { 1 }
"""
PARTS = """
pub struct Piston { pub bore: u8 }
pub struct Valve { owner: Box<Piston>, back: *mut Piston }
pub fn make(n: &str) -> Piston { crate::helper(); Piston { bore: 1 } }
"""
TS = """
export interface Handler { handle(req: Request): Response; }
export interface Admin extends Handler { audit(): void; }
export type Id = string | number;
export enum Method { Get, Post = 3 }
export class Request { id: Id; headers: Map<string, Header>; body?: Body
  constructor(id: Id, private m: Method) { this.id = id; this.check(); } check() {} }
export class Response { status: number; }
class Body {} class Header {}
export class Server implements Handler { routes: Route[]; active: Set<Request>; last: Response | null; wait: Promise<Route>
  handle(req: Request): Response { const r = new Response(); log(`x ${req.id}`); return r; } }
export class Auth extends Server implements Admin { audit(): void { super.audit(); } }
export class Route { handler: Handler; }
export function makeServer(): Server { return new Server(); }
function log(s: string) { console.log(s); }
"""


@pytest.mark.parametrize(
    ("text", "ownership", "refs"),
    [
        ("Vec<Foo>", "owned", {"Foo": "many"}),
        ("&'a mut Bar", "borrow_mut", {"Bar": "one"}),
        ("Option<HashMap<String, Vec<Baz>>>", "owned", {"Baz": "many_keyed"}),
        ("*const u8", "indirection", {}),
        ("()", "primitive", {}),
        ("[Foo; 3]", "owned", {"Foo": "many"}),
        ("Box<dyn Fn(Req) -> Resp>", "owned", {"Fn": "one", "Req": "one", "Resp": "one"}),
        ("String", "primitive", {}),
        ("NonNull<T>", "indirection", {"T": "one"}),
        ("&[Foo]", "borrow_immut", {"Foo": "many"}),
        ("fn(A) -> B", "other", {"A": "one", "B": "one"}),
        ("Self", "owned", {}),
    ],
)
def test_type_expressions(text, ownership, refs):
    got, found, _ = classify_text(text)
    assert (got, {r["name"]: r["cardinality"] for r in found}) == (ownership, refs)


def test_rust_items():
    f = parse_rust("c", "", "src/lib.rs", LIB)
    engine = f.types[0]
    assert engine["derives"] == ["Debug", "Clone"] and engine["doc_first_line"] == "An engine." and engine["lifetime_params"] == ["a"]
    assert [x["name"] for x in f.types[1]["fields"]] == ["Dot", "Line::.0", "Line::.1", "Poly::pts"]
    assert [(e["hint"], e["exposed_name"]) for e in f.exports] == [("self::parts::Piston", "Piston"), ("self::parts::Valve", "Lid")]
    flows = {(x["owner"], x["name"]): x["lifetime_flows_through"] for x in f.functions}
    assert flows[("c::Engine", "build")] and not flows[("c::Engine", "new")]
    assert [x["name"] for x in f.functions if x["owner_kind"] == "type" and x["impl_trait"] == "Run"] == ["go"]


def test_shadowed_and_nested_calls():
    f = parse_rust("c", "m", "src/m.rs", "fn a() { let b = |x| x; b(1); c(b2()); if d() { e::f() } } fn g(h: fn()) { h(); }")
    assert [(x["caller"], x["path"]) for x in f.calls] == [("c::m::a", "c"), ("c::m::a", "b2"), ("c::m::a", "d"), ("c::m::a", "e::f")]


def test_broken_files():
    assert parse_rust("c", "", "x.rs", "struct A { b: ") is None
    with pytest.raises(ValueError):
        parse_ts("c", "", "x.ts", "class A { b(: ")


def test_ts_items():
    f = parse_ts("p", "", "src/index.ts", TS)
    by = {t["name"]: t for t in f.types}
    assert by["Admin"]["trait_impls"] == ["Handler"] and by["Auth"]["derives"] == ["@extends Server"] and by["Body"]["visibility"] == "priv"
    cards = {x["name"]: {r["name"]: r["cardinality"] for r in x["refs"]} for x in by["Server"]["fields"]}
    assert cards == {"routes": {"Route": "many"}, "active": {"Request": "many"}, "last": {"Response": "optional"}, "wait": {"Route": "one"}}
    assert [x["name"] for x in by["Request"]["fields"]] == ["id", "headers", "body", "m"]
    assert [x["name"] for x in by["Method"]["fields"]] == ["Get", "Post"]
    assert {(c["caller"], c["origin"]) for c in f.calls} == {("p::Request::constructor", "this.check"), ("p::Server::handle", "new Response"), ("p::Server::handle", "log"), ("p::Auth::audit", "super.audit"), ("p::makeServer", "new Server"), ("p::log", "console.log")}


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    from factloom.sources.extract import extract

    root = tmp_path_factory.mktemp("tree")
    for name, text in {"rs/Cargo.toml": '[package]\nname = "c"\n', "rs/src/lib.rs": LIB, "rs/src/parts.rs": PARTS, "rs/target/src/x.rs": "struct No;", "rs/src/bad.rs": "struct {{{", "web/package.json": '{"name": "p"}', "web/tsconfig.json": "{}", "web/src/index.ts": TS, "web/src/types.d.ts": "declare class No {}"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return extract(spark, str(root))


def test_tree_types(facts):
    got = {(r.full_path, r.visibility, r.unsafe_blocks) for r in facts.types.where("language = 'rust'").collect()}
    assert got == {("c::Engine", "pub", 0), ("c::Shape", "pub", 0), ("c::Point", "pub", 1), ("c::Run", "pub", 0), ("c::parts::Piston", "pub", 0), ("c::parts::Valve", "pub", 0), ("c::Missing", "<orphan-impl>", 0)}


def test_tree_edges(facts):
    got = {(r.from_id, r.to_id, r.kind, r.cardinality) for r in facts.edges.collect()}
    for row in [
        ("c::Engine", "c::parts::Piston", "owns", "many"),
        ("c::Engine", "c::parts::Valve", "owns", "optional"),
        ("c::parts::Valve", "c::parts::Piston", "indirection", "one"),
        ("c::Shape", "c::Point", "owns", "many"),
        ("c::Point", "c::Run", "trait_impl", "one"),
        ("c::helper", "c::Point", "owns", "one"),
        ("p::Auth", "p::Server", "extends", "one"),
        ("p::Server", "p::Handler", "trait_impl", "one"),
        ("p::Server", "p::Route", "owns", "many"),
        ("p::Route", "p::Handler", "owns", "one"),
    ]:
        assert row in got, row
    assert not {t for _, t, _, _ in got} & {"Map", "Set", "Array", "Promise"}


def test_tree_calls(facts):
    got = {(r.caller, r.callee, r.kind, r.resolution) for r in facts.calls.collect()}
    for row in [
        ("c::Engine::build", "c::parts::make", "function", "exact"),
        ("c::Engine::build", "c::helper", "function", "exact"),
        ("c::Engine::new", "c::Engine::build", "associated_function", "exact"),
        ("c::Engine::spin", "c::Engine::go_on", "method", "exact"),
        ("c::parts::make", "c::helper", "function", "exact"),
        ("p::makeServer", "p::Server::constructor", "associated_function", "exact"),
        ("p::Server::handle", "p::log", "function", "exact"),
        ("p::Request::constructor", "p::Request::check", "method", "exact"),
    ]:
        assert row in got, (row, sorted(got))
    assert not [g for g in got if g[0] == "c::Engine::spin" and g[1] == "c::helper"]


def test_tree_exports(facts):
    got = {(r.exposed_name, r.target, r.target_kind) for r in facts.exports.collect()}
    assert got == {("Piston", "c::parts::Piston", "struct"), ("Lid", "c::parts::Valve", "struct")}


DEEP = """
pub struct A;
pub fn y() -> i32 { 1 }
pub fn z(v: i32) -> bool {
    if !(y() > 0) && v != y() { println!("{}", hidden()); }
    let w = vec![hidden(); 2];
    std::debug_assert!(hidden() > 0);
    macro_rules! inner { () => { hidden() } }
    last()
}
fn hidden() -> i32 { 2 }
fn last() -> bool { true }
mod m {
    impl super::A {
        pub fn x(&self) -> i32 { super::y(); self.q() }
        fn q(&self) -> i32 { 0 }
    }
}
"""


def test_folders_below_src_and_owners_across_modules(spark, tmp_path):
    from factloom.sources.extract import extract

    tree = {
        "w/Cargo.toml": '[lib]\nname = "wrong"\n[package]\nversion = "1"\nname = "deep"\n[[bin]]\nname = "bin"\n',
        "w/src/lib.rs": DEEP,
        "w/src/target/mod.rs": "pub struct T;",
        "w/src/build/mod.rs": "pub struct B;",
        "n/Cargo.toml": '[package]\nversion.workspace = true\n[lib]\nname = "wrong"\n',
        "n/src/lib.rs": "pub struct N;",
        "target/p/Cargo.toml": '[package]\nname = "gone"\n',
        "target/p/src/lib.rs": "pub struct Gone;",
        "w/src/tmp/q/Cargo.toml": '[package]\nname = "gone"\n',
    }
    for name, text in tree.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    facts = extract(spark, str(tmp_path))
    assert {r.full_path for r in facts.types.collect()} == {"deep::A", "deep::target::T", "deep::build::B", "n::N"}
    assert {(r.owner, r.name) for r in facts.functions.where("owner_kind = 'type'").collect()} == {("deep::A", "x"), ("deep::A", "q")}
    calls = {(r.caller, r.callee) for r in facts.calls.collect()}
    assert calls == {("deep::z", "deep::y"), ("deep::z", "deep::last"), ("deep::A::x", "deep::y"), ("deep::A::x", "deep::A::q")}
