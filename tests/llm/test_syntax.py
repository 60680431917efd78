import re
import time

import pytest

from lodestrata.llm import syntax
from lodestrata.llm.chart import Phrases, pairing

VALID = {
    "python": ["x = 1\n", "def f(a, *b, c=1, **d) -> int:\n    return [i for i in a if i]\n", "class A:\n    x: int = 1\n\n    @property\n    async def m(self):\n        async with a as b, c:\n            await d\n", "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nelse:\n    y = f'{x!r:>{w}}'\nfinally:\n    del x\n"],
    "javascript": ["const a = x => ({ b: 1, ...c });\n", "export default class A extends B { #p = 1; get x() { return /[/}]/g.test(`a${b}`); } static async *g() { yield 1 } }\n", "if (a) b(); else if (c) { d } else return1\nfor (const [k, v] of m) {}\nswitch (x) { case 1: y(); break; default: z() }\n", "a = b\n  .c()\n  ?.d ?? e\n"],
    "typescript": ["export function f<T extends A>(a: Map<string, T[]>, b?: number): Promise<void> { return g<T>(a!) as any; }\n", "interface A { x: number; readonly y?: string | null; m(a: B): void }\ntype P = { [K in keyof T]: U };\nenum E { A = 1, B }\n"],
    "java": ["package a.b;\nimport java.util.*;\n@X(y = 1)\npublic class A<T> extends B implements C, D {\n  private final Map<String, List<T>> m = new HashMap<>();\n  public static void main(String[] a) throws E { for (T t : ts) { x.f(y -> y + 1, Z::new); } int[] q = {1, 2}; }\n}\n", "enum E { A(1), B; E() {} }\nrecord R(int a, String b) {}\n"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n)\n\ntype T struct {\n\tA int `json:\"a\"`\n\t*B\n}\n\nfunc (t *T) F(a, b string) (int, error) {\n\tm := map[string]int{\n\t\t\"a\": 1,\n\t}\n\tfor i, v := range m {\n\t\tgo func() { ch <- v }()\n\t}\n\tif err := f(); err != nil {\n\t\treturn 0, err\n\t}\n\tswitch x := y.(type) {\n\tcase int:\n\t}\n\treturn len(m), nil\n}\n"],
    "json": ['{"a": [1, -2.5e3, true, null, "x\\n"], "b": {}}', "[]", '"x"'],
    "yaml": ["a: 1\nb:\n  - x\n  - y: 2\n    z: [1, {k: v}]\nc:\n- d\ntext: |\n  any: thing\n   goes\nq: \"a: b\"\n", "- a\n- - b\n  - c\n# end\n", "---\na: &x 1\nb: *x\n"],
    "bash": ["#!/bin/bash\nif [ -z \"${A:-}\" ]; then\n  echo 'x' >&2\nelif true; then :\nfi\nfor i in a b; do f \"$i\" || g; done\ncase $x in\n  a|b) y ;;\n  *) z ;;\nesac\nf() {\n  cat <<EOF\nif (\nEOF\n}\nx=$(a | b)\n"],
}
VALID["bash"] += [
    "for ((i=0;i<3;i++)) do echo; done\n", "a=(1 2 \"x y\")\nb[1]=3 c\nb+=( $(ls) )\n", "while read -r x; do y; done < <(z)\n", "case a in (b) c;; d|e) f\nesac\n", "until a; do b; done | c &\nfunction z() { q; }\nx() ( y )\n",
    "[[ -n $x && ( $y == z ) ]] || exit 1\necho ${a#b} $((1 + (2*3))) {a,b} a{1}b\n", "if ! a; then b; fi > x 2>&1\ncat <<< y\n", "a &&\n  b |\n  c\n", "for x\ndo y; done\n", "echo 'a\nb' # it's\n", "while while a; do b; done; do c; done\n",
]
VALID["yaml"] += ["a: {b: [1, 'c, d', \"e: f\"], g: h}\n", "a:\n- b: 1\n  c:\n  - d\n- e\nf: x\n  goes on\n", "--- # first\na: b\n...\n---\n- c\n", "? a\n: b\n", "a: it's \"fine\"\nurl: http://x/y#z\n", "[a, b,\n c]\n", "a: >-\n\n  x: y\n   z\nb: !t {}\n", "'q': 1\n\"r s\": 2\n"]
VALID["python"] += ["print('a' 'b')\nf(*a, b=1, **c)\nf(x=1, *y)\n", "def f(a, /, b=1, *, c, d=2, **e): pass\n", "a, *b = c.d[0] = e\nx: int = 3\n(a) = 0x1F + 1_000 + 1e-3j + .5\n", "match x:\n    case [a, *_] if a: pass\n", "lambda *a, b=1: (yield)\n", "for i, (a, b) in x: pass\n", "if (n := f()) > 1: pass\n", "type X = int\n"]
VALID["javascript"] += ["a ? b : c ? d : e;\nconst {x: y = 1, ...z} = w;\nlabel: for (;;) { break label }\n", "const o = { a, b: 1, 'c': x => y, [d]: 2, get e() { return 1 }, async *f() {} };\nvar type = 1, to = 2;\n"]
VALID["java"] += ["class A { int[] a = {1, 2}; int[][] b = {{1}, {2}}; @B({\"x\", \"y\"}) void f() { int x = 1; if (x > 0) y(); else { z(); } } }\n", "enum E { A, B }\nenum F { C { void m() { } }, D; int x; }\n", "class A { Runnable r = () -> { f(); }; int v = switch (x) { case 1 -> 2; default -> { yield 3; } }; List<String> l = new ArrayList<>() {{ add(\"a\"); }}; }\n"]
VALID["go"] += ["package a\nfunc f() {\n\tif x := []int{1}; len(x) > 0 {\n\t}\n\tfor _, v := range []T{{1}, {2}} {\n\t}\n\tif v == (T{1}) {\n\t}\n\tswitch {\n\tcase a:\n\t}\n}\n"]
VALID["typescript"] += ["interface A<T> extends B { readonly x?: string | null; [k: string]: T; (a: number): void; new (a: T): A<T>; m?(b: T): void; get y(): T }\n", "abstract class A { private x: number = 1; constructor(readonly y: string) { super() } abstract m(): void; }\ndeclare module 'x' { }\n"]
INVALID = {
    "python": ["def f(:\n    pass\n", "x = [1, 2\n", "if x\n    y = 1\n", "  x = 1\n y = 2\n", "class A:\n", "x = 'a\n", "package a;\nimport b.c;\n"],
    "javascript": ["const a = ;\n", "f(a, b;\n", "x = {a: 1\n", "import os\ndef f(x):\n    return x\n", "a = `x\n", "x = b c\n"],
    "typescript": ["function f(a: number { }\n", "const x: = 1;\n", "x = [1, 2}\n"],
    "java": ["class A { void f( { } }\n", "class A { int x = ; }\n", "import { a } from 'b';\n", "class A {\n"],
    "go": ["package a\nfunc f( {\n}\n", "package a\n\nx := [1, 2\n", "import os\nfrom a import b\n"],
    "json": ['{"a": 1,}', "{'a': 1}", '{"a" 1}', '{"a": 1}}', "[1, 2", "[1,,2]", "1 2"],
    "yaml": ["a: 1\n  b: 2\n", "a: [1, 2\n", "a: \"x\n", "a: b: c\n", "a:\n\t- x\n", "- a\nb: 1\n"],
    "bash": ["if true; then\n  x\n", "for i in a; do\n  b\n", "echo \"x\n", "f() {\n", "fi\n", "x | | y\n"],
}


INVALID["python"] += ['print "a"\n', 'exec "x"\n', "def f(a=1, b): pass\n", "f(a=1, 2)\n", "f(**a, 1)\n", "1 = x\n", "f() = 1\n", "'a' = b\n", "x = 08\n", "x = 1__0\n", "try:\n    a\nexcept A, e:\n    b\n"]
INVALID["java"] += ["class A { void f() { int x = 1 } }\n", "class A { void f() { if (a) { x = 1 } } }\n", "class A { int x; int y }\n"]
INVALID["typescript"] += ["interface A { x: ; }\n", "interface A { x: number y: string }\n"]
INVALID["javascript"] += ["const x: number = 1;\n", "function f(a: string): number { }\n", "interface A { x }\n", "enum E { A }\n", "abstract class A { }\n", "let y = x as string;\n", "class A { private x = 1; }\n"]
INVALID["go"] += ["package a\nfunc f() {\n\tif x = { }\n}\n"]
INVALID["json"] += ["NaN", "[Infinity]", "[-Infinity]", "-", "[01]"]
INVALID["bash"] += ["foo(a, b)\n", "import os\nclass A(B):\n  x\n", "def f(a):\n  return 1\n", "function f(a) { return g(a); }\n", "if then fi\n", "for i in a; b; done\n", "case x in a) b\n", "x()\n", "{ a }\n", "&& a\n", "while a; b; done\n", "if a; then b; else; c; fi; fi\n", "a\n<<<<<<< x\nb\n=======\nc\n>>>>>>> y\n", "cat ) x\n"]
INVALID["yaml"] += ["a: {b: 1, c: }}\n", "a: [1,, 2]\n", "a: 'x\n", "a: b\n c: d\n", "a: @x\n", "a:\n    b: 1\n  c: 2\n", "a: [1, 2\nb: 3\n"]


@pytest.mark.parametrize("language,text", [(k, t) for k, v in VALID.items() for t in v])
def test_valid_texts_cost_nothing(language, text):
    assert syntax.PARSERS[language](text).cost == 0
    assert syntax.PARSERS[language](text.replace("\n", "\r\n")).cost == 0 or language in ("bash",)


@pytest.mark.parametrize("language,text", [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid_texts_need_repair(language, text):
    assert syntax.repair(language, text)[0] > 0


def test_least_cost():
    grammar = Phrases("a(bc)*d")
    assert [grammar.cost(w) for w in ("abcbcd", "abcbd", "abcbc", "xabcd", "", "abxd")] == [0, 1, 1, 1, 2, 1]


def test_causes():
    valid = "import os\n\n\ndef f(a):\n    return a\n" * 5
    assert syntax.repair("python", valid + "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n")[1] == "conflict"
    assert syntax.repair("python", valid + "x = f(1,\n")[1] == "truncated"
    assert syntax.repair("java", "from a import b\nimport os\n\ndef f(x):\n    return 'abc'\n" * 9)[1] == "foreign"


def test_causes_and_costs_know_no_size():
    """A short text has the cause of a long one of its kind, and brackets are paired at least cost however many there are."""
    import itertools

    foreign = "from a import b\nimport os\n\ndef f(x):\n    return 'abc'\n"
    assert [syntax.repair("java", foreign * n)[1] for n in (1, 2, 9, 40)] == ["foreign"] * 4
    assert [syntax.repair("json", text)[1] for text in ('{"a": 1,}', "[1, 2", '{"a": [1, {"b": 2')] == ["damaged", "truncated", "truncated"]
    kinds = {"(": ")", "[": "]"}
    for n in (1_400, 1_500, 1_501, 1_502, 2_001):
        assert pairing("(" * n, kinds)[0] == pairing(")" * n, kinds)[0] == (n + 1) // 2
        assert pairing("(" * (n // 2) + "]" * (n - n // 2), kinds)[0] == (n + 1) // 2
    for closing, opening in itertools.product(range(6), repeat=2):
        assert pairing(")" * closing + "[" * opening, kinds)[0] == (closing + 1) // 2 + (opening + 1) // 2


def test_files(spark):
    rows = [("r", "a.py", None, "x = (", "k"), ("r", "a.py", None, "x = (", "k"), ("r", "b.py", "python", None, None), ("r", "c.py", "python", " ", None), ("r", "d.md", "markdown", "(", None), ("r", None, None, "(", None), ("r", "e.json", None, "{}", None)]
    df = spark.createDataFrame(rows, "repo_id string, relative_path string, language string, content string, cost string")
    checked = syntax.check_files(df)
    assert [tuple(r) for r in syntax.invalid_files(checked).collect()] == [("r", "a.py")]
    assert {(r["language"], r["files"], r["invalid"]) for r in syntax.rates(checked).collect()} == {("python", 1, 1), ("json", 1, 0)}
    assert syntax.invalid_files(syntax.check_files(df.limit(0))).count() == 0


def test_lexers_are_linear():
    for text in ('x="' + "$(a)" * 10_000, "x='" + "\\'" * 10_000, "`" * 9_999, "${" * 5_000, "$((" * 3_000, "if " * 2_000, "(" * 2_000, 'echo "' + "`a` $b " * 5_000):
        began = time.time()
        syntax.repair("bash", text)
        assert time.time() - began < 5, text[:20]
    for language in ("javascript", "java", "go", "python", "json", "yaml"):
        for text in ('x = "' + "\\" * 9_999, "x = `" + "${a}" * 9_999, "'" * 9_999, "[" * 700 + "}" * 700, "/*" * 5_000, "a: \"" + "b: " * 3_000):
            began = time.time()
            syntax.repair(language, text)
            assert time.time() - began < 10, (language, text[:20])


def test_least_costs_by_brute_force():
    """Exact edit distance to a small language, and to balanced brackets, against enumeration."""
    import itertools
    import itertools

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    words = ["".join(w) for n in range(6) for w in itertools.product("ab(", repeat=n)]
    inside = [w for w in words if re.fullmatch("(ab)*b?|ba+", w)]
    grammar = Phrases("(ab)*b?|ba+")
    for w in words[:200]:
        assert grammar.cost(w) == min(distance(w, v) for v in inside), w
    brackets = ["".join(w) for n in range(0, 7, 2) for w in itertools.product("()[]", repeat=n)]

    def balanced(w):
        while (v := w.replace("()", "").replace("[]", "")) != w:
            w = v
        return not w

    good = [w for w in brackets if balanced(w)]
    for n in range(5):
        for w in itertools.product("()[]", repeat=n):
            w = "".join(w)
            assert pairing(w, {"(": ")", "[": "]"})[0] == min(distance(w, v) for v in good), w


def test_blank_contents_are_no_case(spark):
    rows = [("r", f"a{i}.json", None, text) for i, text in enumerate(["\n\n", "\r\n", " \t\n", ""])]
    df = spark.createDataFrame(rows, "repo_id string, relative_path string, language string, content string")
    assert syntax.check_files(df).count() == 0
