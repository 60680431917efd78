from lodestrata.operators import chunking
from lodestrata.operators.grammar import LANGUAGES, declarations

JS = """import x from 'y';

function greet(name) {
  const s = `}${name}{`;
  return s + "}" + /[}{]/.test(s);
}

class Greeter {
  constructor(a) {
    this.a = a; // }
  }

  static async *run() {
    yield 1;
  }
}

const add = (a, b) => {
  return a + b;
};

const chain = load()
  .then(x => x)
  .catch(y => y);

export default function late() {
  return 1;
}
if (x) {
  y();
}
"""


def shape(language, text):
    return [(n.kind, n.name, n.start, n.end) for n in declarations(language, text)]


def test_script():
    want = [
        ("function_declaration", "greet", 3, 6), ("class_declaration", "Greeter", 8, 16), ("lexical_declaration", "add", 18, 20),
        ("lexical_declaration", "chain", 22, 24), ("export_statement", "late", 26, 28),
    ]
    assert shape("javascript", JS) == want and shape("javascript", JS.replace("\n", "\r\n")) == want
    assert [(m.kind, m.name, m.start, m.end) for m in declarations("javascript", JS)[1].members] == [("method_definition", "constructor", 9, 11), ("method_definition", "run", 13, 15)]
    ts = "@Component({a: 1})\nexport class A<T> {\n  x: number;\n  m(a: B): void {\n  }\n}\n\ninterface I {\n  a: string\n}\ntype T = {\n  b: 1;\n};\nenum E {\n A\n}\n"
    assert shape("typescript", ts) == [("export_statement", "A", 1, 6), ("interface_declaration", "I", 8, 10), ("type_alias_declaration", "T", 11, 13)]


def test_java_and_go():
    java = "package a;\n@X(y = {1, 2})\npublic final class A<T> extends B {\n  int x = 1;\n  public A(int q) {\n  }\n  List<Map<String, T>> f(int[] a) throws E {\n    if (a) { }\n  }\n}\ninterface I {\n  void m();\n}\n"
    assert shape("java", java) == [("class_declaration", "A", 2, 10), ("interface_declaration", "I", 11, 13)]
    assert [(m.kind, m.name, m.start, m.end) for m in declarations("java", java)[0].members] == [("constructor_declaration", "A", 5, 6), ("method_declaration", "f", 7, 9)]
    go = "package a\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) M(a int) (int, error) {\n\treturn 1, nil\n}\n\nfunc F() {\n\ts := `}`\n}\n\nvar v = map[string]int{\n\t\"a\": 1,\n}\n"
    assert shape("go", go) == [("type_declaration", "T", 3, 5), ("method_declaration", "M", 7, 9), ("function_declaration", "F", 11, 13), ("var_declaration", "v", 15, 17)]


def test_other_languages():
    rust = "use a;\npub fn f<'a>(x: &'a str) -> u8 {\n  1\n}\nimpl<T> A for B {\n  fn m(&self) {\n  }\n}\npub struct S {\n  a: u8,\n}\n"
    assert shape("rust", rust) == [("function_item", "f", 2, 4), ("impl_item", None, 5, 8), ("struct_item", "S", 9, 11)]
    cpp = "#include <a>\nnamespace n {\nclass A {\n  void m() {\n  }\n};\n}\nint main(int c, char** v) {\n  return 0;\n}\nstatic int table[] = {\n  1,\n};\n"
    assert shape("cpp", cpp) == [("namespace_definition", "n", 2, 7), ("function_definition", "main", 8, 10), ("declaration", "table", 11, 13)]
    ruby = "module M\n  class A\n    def x\n      1\n    end\n    def self.y\n    end\n  end\nend\n# end\n"
    assert shape("ruby", ruby) == [("module", "M", 1, 9)]
    assert [m.name for m in declarations("ruby", ruby)[0].members[0].members] == ["x", "y"]
    cs = "using S;\nnamespace N\n{\n  public class A\n  {\n    public int F(int a)\n    {\n      return 1;\n    }\n  }\n}\n"
    assert shape("c_sharp", cs) == [("namespace_declaration", "N", 2, 11)]


def test_odd_texts_end():
    for language in LANGUAGES:
        for text in ("", "}", "{" * 500, "class", "\"", "/*", "func (", "export", "@A(" * 200, "a b c\n" * 500, "\x00'`\\"):
            declarations(language, text)


def test_oversized_split_at_members():
    body = "".join(f"  m{i}(a) {{\n" + "    x();\n" * 20 + "  }\n" for i in range(4))
    parts = chunking.declared_parts("javascript", "class Big {\n" + body + "}\n")
    assert [(p[3], p[4], p[1] - p[0] + 1) for p in parts] == [(f"m{i}", f"Big > m{i}", 22) for i in range(4)]
    assert [(p[0], p[1]) for p in chunking.declared_parts("go", "func Big() {\n" + "\tx()\n" * 100 + "}\n")] == [(1, 60), (51, 102)]


def test_files(spark):
    rows = [("r", "a.js", "javascript", JS), ("r", "s.js", "javascript", "a();\nb();\nc();\n"), ("r", "n.js", "javascript", None), ("r", "e.js", "javascript", ""), ("r", "t.sh", "bash", "\n".join(f"echo {i}" for i in range(100))), (None, "q.xx", None, "a\nb\nc"), ("r", None, "bash", "a\nb\nc")]
    df = spark.createDataFrame(rows, "repo_id string, relative_path string, language string, content string")
    got = chunking.chunk_files(df)
    assert {r["id"] for r in got.collect()} == {"r:a.js:3-6", "r:a.js:8-16", "r:a.js:18-20", "r:a.js:22-24", "r:a.js:26-28", "r:s.js:1-3", "r:t.sh:1-60", "r:t.sh:51-100", "q.xx:1-3"}
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
