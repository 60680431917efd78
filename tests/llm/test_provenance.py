from lodestrata.llm import provenance

CODE = "".join(f"def rare_name_{i}(alpha, beta):\n    return alpha * {i} + beta.call_{i}(alpha)\n\n" for i in range(12))
SHAPE = "repo_id string, relative_path string, content string, n bigint, label string"


def labels(spark, rows):
    df = spark.createDataFrame([(r, p, c, 1, "x") for r, p, c in rows], SHAPE)
    return {r["relative_path"]: r["label"] for r in provenance.label_files(df).collect()}


def test_labels(spark):
    numbers = "module.exports = [\n" + "".join(f"  [{i}.5, {i}.25, -{i}],\n" for i in range(60)) + "];\n"
    rows = [
        ("a", "src/gen.py", "# Code generated by tool 1.2.3. DO NOT EDIT.\nx = 1\n"), ("a", "src/was.py", "# no longer generated by tool, maintained by hand since 2020\n" + CODE[:200]),
        ("a", "src/str.py", 'banner = "# @generated by %s"\n'), ("a", "x/app.min.js", "!function(){" + "a=b(c);" * 200 + "}();"), ("a", "x/long.py", CODE.replace("rare", "own") + 'q = "SELECT ' + "a, " * 500 + '"\n'),
        ("a", "x/map.json", '{"version": 3, "file": "a.js", "mappings": "' + "AAAA;" * 300 + '"}'), ("a", "x/rows.js", numbers), ("a", "x/dump.sql", "".join(f"INSERT INTO t VALUES ({i}, 'a', {i});\n" for i in range(40))),
        ("a", "x/conf.properties", "".join(f"a.b.c{i}=value{i}\n" for i in range(40))), ("a", "lib/one.py", "# quill v1.2.3 - https://quill.example\n# (c) 2019 the quill contributors, MIT licensed\n" + CODE),
        ("b", "third_party/quill/one.py", CODE), ("c", "src/own/one.py", CODE.replace("alpha * 3", "alpha * 33")), ("c", "vendor/mine.py", "def f():\n    return 1\n"), ("c", "n.py", None), ("c", "e.py", ""), ("a", "src/gen.py", "# Code generated by tool 1.2.3. DO NOT EDIT.\nx = 1\n"),
    ]
    got = labels(spark, rows)
    assert {k for k, v in got.items() if v is None} == {"src/was.py", "src/str.py", "x/long.py", "x/conf.properties", "vendor/mine.py"}
    assert {k: v for k, v in got.items() if v} == {
        "src/gen.py": "generated", "x/app.min.js": "minified", "x/map.json": "minified", "x/rows.js": "data", "x/dump.sql": "data",
        "lib/one.py": "vendored", "third_party/quill/one.py": "vendored", "src/own/one.py": "vendored",
    }


def test_empty(spark):
    assert labels(spark, []) == {}


def test_popular_and_many_releases(spark):
    head = "# quill v1.2.{} - https://quill.example\n"
    popular = [("a", f"s{i}/one.py", head.format(i) + CODE) for i in range(3)] + [("b", f"c{i}/one.py", CODE) for i in range(40)]
    release = lambda i: "".join(f"def index_{i}_{j}(alpha):\n    return beta_{i}_{j}(alpha)\n" for j in range(12))
    many = [("c", f"m{i}/index.py", "# (c) 2019 the osier contributors\n" + release(i)) for i in range(6)] + [("d", "x/index.py", release(4))]
    mixed = "".join(f"def index_{i}_1(alpha):\n    return beta_{i}_1(alpha)\n" for i in range(6))
    got = labels(spark, popular + many + [("d", "mixed/index.py", mixed), ("d", "own.py", CODE.replace("rare", "mine").replace("call", "made"))])
    assert {k for k, v in got.items() if v is None} == {"mixed/index.py", "own.py"}


def test_long_heads():
    licence = [f"// Licence text, line {i}" for i in range(20)]
    marker = "// Code generated by protoc-gen-go. DO NOT EDIT."
    assert provenance.header_claims([*licence, marker, "package a"]) == (True, None)
    assert provenance.header_claims([*licence, "", "package a", *["x := 1"] * 30, marker]) == (True, None)
    block = ["#!/usr/bin/env python", '"""A module.', *["More about it."] * 20, "Vendored from quill release 2.1", '"""']
    assert provenance.header_claims([*block, "import os"]) == (False, "quill")
    assert provenance.header_claims([*licence, "package a", *["x := 1"] * 30, "// generated by hand-run tool 1.2"]) == (False, None)
    assert provenance.header_claims(["x = 1"] * 30 + ['s = "// Code generated by x. DO NOT EDIT."']) == (False, None)


def test_folders_named_like_a_project(spark):
    """A claim on a project in one repository makes no stranger's folder of that name third-party."""
    own = lambda k: CODE.replace("rare", f"own{k}").replace("call", f"made{k}")
    rows = [("a", "lib/x.py", "# Copied from utils release 1.0\n" + own(0)), ("a", "lib/utils/y.py", own(1))]
    rows += [(f"r{k}", f"app/utils/z{k}.py", own(k + 2)) for k in range(4)] + [("s", "third_party/utils/w.py", own(9)), ("t", "vendor/mine/v.py", own(10)), ("u", "quill-1.2.3/q.py", own(11))]
    got = labels(spark, rows)
    assert {k for k, v in got.items() if v} == {"lib/x.py", "lib/utils/y.py", "third_party/utils/w.py", "quill-1.2.3/q.py"}


def test_one_long_literal_is_no_compression():
    query = "SELECT " + ", ".join(f"alpha{i}.beta{i}" for i in range(200))
    text = f'const a = load();\n  const q = "{query} FROM x";\nrun(q);\n'
    assert provenance.composition("a/b.ts", text, text.split("\n")) is None
    small = "!function(){" + 'a=b("x",c);' * 200 + "}();"
    assert provenance.composition("a/b.js", small, [small]) == "minified"
