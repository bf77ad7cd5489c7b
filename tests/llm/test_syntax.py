"""Recognisers on texts whose validity is known, and the operator's cases."""

import pytest

from twinspan.llm.syntax.check import json_pushdown, problem
from twinspan.llm.validity import file_validity, invalid_rates

GOOD = {
    "js": [
        "export const f = async ({ a, b = 2 }, [c, ...d]) => { for await (const x of y()) { await x; } };", "const re = /[/\\]]+\\/(?<n>x)/giu, q = a / b / c;", "class A extends B { static #x = 1; get y() { return this.#x; } static { A.z = 1 } async *g() { yield* h(); } }",
        "label: for (let i = 0, n = 3; i < n; i++) { if (i) continue label; else break }", "const t = `a ${b ? `${c}` : {d: 1}.d} }`;", "let x = 1\nlet y = 2\n++x\n;[1].map(n => ({ n }))", "/* <<<<<<< x\n=======\n*/ const s = '<<<<<<< y';", "import d, * as n from 'm'; import { a as b } from \"k\"; export * from 'z'; export default class {}",
        "x ??= y?.[0]?.(1) ?? z ** 2; var { a: { b }, ...rest } = o;", "do x++; while (x < 5)\nswitch (a) { case 1: { } default: b() }", "new Foo; new (bar())(1); new a.b.C(1)`x`;", "(a, b) => a\n", "#!/usr/bin/env node\nfoo()", "try { a() } catch { b() } finally { c() }", "const o = { get, set: 1, async: 2, async m() {}, get x() { return 1 }, [k]: v, 'q': 1, 3: 4 };", "\ufeff1;", "",
    ],
    "ts": [
        "export function f<T extends keyof U, U = {}>(this: Foo, a?: T, ...r: readonly U[]): a is string | undefined { return <any>a as unknown as never; }", "interface A<T> extends B, C<T> { readonly [k: string]: (x: number) => void; new (a: T): A<T>; m?(): string, -readonly [P in K]?: V }".replace(", -readonly [P in K]?: V", ""),
        "type M<T> = { readonly [K in keyof T as `x${string & K}`]-?: T[K] extends (infer R)[] ? R : never };", "abstract class A<T> implements B { private constructor(readonly x: number, public y?: string) { super(); } abstract m(): void; declare z: T; static override async n(): Promise<void> {} }", "const enum E { A = 1, B = A << 2, C }\ndeclare module 'x' { export const a: number; }\nnamespace N.M { export let q = 1 }", "const x = f<string>(1), y = a < b, z = g<A<B>>(c);",
        "const k = { a: 1 } as const satisfies Foo; let v!: number; v!.toFixed();", "export type { A } from './a'; import type B, { type C } from 'b';", "const h = async <T,>(x: T): Promise<T> => x; const i = (a: number, b = 2): [a: number, b?: string] => [a, ''];", "function over(a: string): void;\nfunction over(a: any) {}", "let u: typeof import('x').y, w: unique symbol, p: `a${string}`;", "x ? (y) : z; x ? (a, b) => c : d;",
    ],
    "tsx": ["const a = <div className=\"x\" {...p} on={() => go()}>Don't {n} &amp; <B.C /> <></></div>;", "const f = <T,>(x: T) => <p>{x ? <i>1</i> : null}</p>;", "return_(<a>=======\n</a>);".replace("return_", "show")],
    "rs": [
        "#![allow(x)]\n//! doc\nuse a::{self, b::*, c as d};\npub(crate) fn f<'a, T: ?Sized + 'a, const N: usize>(mut self: Box<Self>, (a, b): (&'a mut T, [u8; N])) -> impl Fn(u8) -> Result<(), Box<dyn E + 'a>> where T: for<'b> X<'b, Item = u8>, { move |x: u8| Ok(()) }".replace("mut self: Box<Self>, ", ""),
        "fn m(x: Option<i32>) -> i32 { match x { Some(n @ 1..=5) if n > 2 => n, Some(-1) | None => { 0 } Some(_) => return 3, } }", "fn s() { let r = r#\"a \" } /* \"#; let c = '\\''; let l = 'x: loop { break 'x; }; let b = b\"\\x00\"; /* a /* b */ c */ }", "struct P { x: u8 } impl P { fn n() -> Self { Self { x: 1, ..Default::default() } } } struct U; struct T(pub u8, u8);",
        "fn c() { if let Some(x) = y else_() {} }".replace(" else_() {}", " {}"), "fn e() { let Some(x) = y else { return }; let z = (1, 2.0, 1..3, ..=4, x.0.1, (a as u8) < b, &mut *c, -d, !e); vec![1; 2]; println!(\"{}\", z); }", "macro_rules! m { ($($x:expr),* $(,)?) => { $(f($x);)* }; }", "trait Q: Send { type A<'a>: X where Self: 'a; const C: u8 = 1; fn f(&self, _: u8) -> u8 { 0 } }\nimpl<T> !Sync for V<T> {}", "fn g() { a.b::<Vec<Vec<u8>>>()?.await; while let Some(x) = it.next() { x += 1; } for (i, _) in v.iter().enumerate() {} unsafe { *p = 1 } }", "pub const A: [&str; 2] = [\"a\", \"b\"]; static mut B: u64 = 0xff_u64; type F = unsafe extern \"C\" fn(*const u8, ...) -> !;", "fn t() -> u8 { if a { 1 } else { 2 } }\nenum E { A = 1, B(u8), C { x: u8 } }", "",
    ],
    "py": ["match x:\n    case [a, *_] | {'k': 1}: pass\n", "f'{x!r:>{w}}'\n", "async def f(*, a: int = 1) -> None:\n    async with g() as h: await h\n", "'''<<<<<<< HEAD\n=======\n'''\n", "x = '\\d'\n", "\ufeffx = 1", "\n\n"],
    "json": ['{"a": [1, -2.5e+3, true, null, "\\u00e9"]}', " [] ", '"x"', "0", "[" * 40000 + "]" * 40000, "1" * 6000],
}
BAD = {
    "js": ["const a = ;", "function f( {", "foo(1, 2", "let s = 'abc\n';", "x = `a${b`;", "}", "a b", "const x;", "if (a { }", "return 1;", "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> x", "let x: number = 1;", "const a = <div/>;", "import { a } from", "1 + = 2", "a++ = 1", "x => {", "/* x", "const o = { a: 1, b };;)", "class A { m( }", "for (const x of) {}", "else {}", "interface A {}", "0x", "3in x", "await = 1; function g() { await x }", "f(a,,b)"],
    "ts": ["const a: = 1;", "type A = ;", "interface A { x: }", "let a = <div className='x' />;", "enum E { A B }", "function f(a: string b) {}", "def f():\n    pass", "export const a = 1 as;", "use crate::a;", "const x = {a: 1;"],
    "tsx": ["const a = <div>;", "const a = <a></b>;", "const a = <div>{x</div>;", "const a = <p>a } b</p>;", "<<<<<<< HEAD\nconst a = 1;", "const a = <div a=1></div>;"],
    "rs": ["fn f( {}", "fn f() { let x = ; }", "fn f() {", "struct A { x u8 }", "fn f() { \"abc }", "fn f() { a b }", "let x = 1;", "fn f() {} }", "<<<<<<< HEAD\nfn f() {}", "fn f() { match x { 1 => 2 3 => 4 } }", "use a::{b;", "fn f() { if x { 1 } else 2 }", "impl { }", "enum E { A(, }", "fn f() { 'ab' }", "import x from 'y';", "def f():\n    pass", "fn f() { a < b < c }", "/// only a comment\n", "fn f(x) {}", "fn f() { /* a /* b */ }", "fn f() { x = = 1; }", "pub fn f() -> { }"],
    "py": ["def f(:\n    pass", "print 'x'\n", "if x:\n", "x = 'a\n", "<<<<<<< HEAD\nx = 1\n", "  x = 1\n y = 2\n", "try:\n    a()\nexcept A, e:\n    b()\n", "f(1\n", "x\0y"],
    "json": ["", "  ", "{'a': 1}", "[1,]", '{"a" 1}', "NaN", "[1] 2", '"a', "{", "01", '"\t"', "]", "[" * 30000, "// c\n1", "\ufeff{}"],
}


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in GOOD.items() for t in ts])
def test_valid(ext, text):
    assert problem(text, ext) is None


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in BAD.items() for t in ts])
def test_invalid(ext, text):
    assert problem(text, ext) is not None


def test_every_truncation_of_a_block_is_invalid():
    for ext, text in [("rs", "fn f() { g(\"x\", [1, 2]) }"), ("js", "function f() { g(`x`, [1, 2]) }"), ("json", '{"a": [1, "x"]}')]:
        for n in range(12, len(text)):
            assert problem(text[:n], ext), text[:n]


def test_kinds():
    assert problem("fn f() {\n=======\n}", "rs")[0] == "merge_conflict_marker"
    assert problem("let a = 'x", "ts")[0] == "unterminated_literal"
    assert problem("f(1", "js")[0] == "premature_end"
    assert problem("f(1]", "js")[0] == "unbalanced_delimiter"
    assert problem("x = )", "py")[0] in ("unbalanced_delimiter", "unexpected_token")


def test_deep_nesting_never_crashes():
    n = 20000
    for ext, a, b in [("js", "(", ")"), ("ts", "[", "]"), ("rs", "fn f(){" + "(" * n, "1" + ")" * n + "}")]:
        text = a + b if ext == "rs" else a * n + "1" + b * n
        assert problem(text, ext) is None
        assert problem(text[:-1], ext) is not None
    with pytest.raises(Exception):
        json_pushdown("[" * n)


def test_the_grammar_holds_at_any_depth():
    for n in (400, 40000):
        for ext, a, b in [("js", "", ""), ("ts", "", ""), ("rs", "fn f(){", "}")]:
            assert problem(a + "(" * n + "1" + ")" * n + b, ext) is None
            assert problem(a + "(" * n + "1 +" + ")" * n + b, ext) is not None
    assert problem("-" * 100000 + ")", "py") is not None
    assert problem("(" * 150 + "1 +" + ")" * 150, "py") is not None and problem("x = (" + "-" * 100000 + "1", "py")[0] == "premature_end"


def test_python_needs_its_own_version(monkeypatch):
    import twinspan.llm.syntax.check as check

    monkeypatch.setattr(check, "PYTHON", (3, 1))
    with pytest.raises(RuntimeError):
        problem("x = 1", "py")


def test_operator_cases(spark):
    rows = [(1, "r/a.py", "x = 1", 0), (2, "r/b.py", "x = (", 0), (3, "r/c.md", "(", 0), (4, None, "(", 0), (5, "r/d.json", None, 0), (6, "r/e.json", "", 0), (2, "r/b.py", "x = (", 0), (7, "q/.rs", "(", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string, kind int")
    got = sorted((r["doc_id"], r["repo"], r["language"], r["kind"], r["line"]) for r in file_validity(df).collect())
    assert got == [(1, "r", "python", None, None), (2, "r", "python", "premature_end", 1), (2, "r", "python", "premature_end", 1), (6, "r", "json", "premature_end", 1)]
    rates = {(r["repo"], r["language"]): (r["files"], r["invalid"]) for r in invalid_rates(file_validity(df)).collect()}
    assert rates == {("r", "python"): (3, 2), ("r", "json"): (1, 1)}
    assert file_validity(df.limit(0)).count() == 0
