import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodestrata.operators import chunking, context, lexical, retrieval, scan, store, vectors

FILE = "repo_id string, relative_path string, size_bytes bigint, content string, content_hash string, language string"


def files(spark, rows):
    return spark.createDataFrame(rows, FILE)


def test_scan_keeps_supported_files(spark):
    rows = [
        ("r", "src/__init__.py", 3, "x=1", "a", "python"), ("r", "node_modules/big.js", 3, "", "b", None), ("r", "package-lock.json", 3, "", "c", None),
        ("r", "big.py", 600_000, "", "d", None), ("r", ".gitignore", 1, "", "e", None), ("r", "a.pyc", 1, "", "f", None), ("r", None, 1, "", "g", None), ("r", "n.py", None, "x", "h", None),
    ]
    assert {r["relative_path"] for r in scan.select_files(files(spark, rows)).collect()} == {"src/__init__.py", "n.py"}


def test_ignore_rules(spark):
    paths = ["a/x.txt", "b.log", "keep.log", "build/y.py", "src/build", "a.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r["p"] for r in df.where(scan.gitignored(["*.log", "!keep.log", "/x.txt", "build/"])("p")).collect()}
    assert got == {"a/x.txt", "b.log", "build/y.py", "src/build"}
    paths = ["apps/a.py", "lib/apps/a.py", "x/cat.py", "x/bat.py", "q/r/s.py", "a+b.py", "aab.py"]
    df = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string")
    got = {r["p"] for r in df.where(scan.gitignored(["/apps", "[!b]at.py", "q/", "!q/r/s.py", "a+b.py", "#x", "/"])("p")).collect()}
    # a folder that is left out is not entered again; a leading slash still matches behind a slash
    assert got == {"apps/a.py", "lib/apps/a.py", "x/cat.py", "q/r/s.py", "a+b.py"}


def test_scan_differences(spark):
    now = files(spark, [("r", "a", 1, "", "1", None), ("r", "b", 1, "", "2", None), ("r", "c", 1, "", "3", None), ("r", "e", 1, None, None, None)])
    state = spark.createDataFrame([("r", "a", "1"), ("r", "b", "9"), ("r", "d", "4"), ("r", "a", "1")], "repo_id string, relative_path string, content_hash string")
    assert {r["relative_path"] for r in scan.changed_files(now, state).collect()} == {"b", "c", "e"}
    assert [r["relative_path"] for r in scan.deleted_files(now, state).collect()] == ["d"]
    assert scan.diff_counts(now, state).first().asDict() == {"repo_id": "r", "added": 2, "changed": 1, "unchanged": 1, "deleted": 1}


def test_areas(spark):
    rows = [("r", "backend/pom.xml", 10, "", "", None), ("r", "backend/src/main/java/A.java", 10, "", "", None), ("r", "ui/package.json", 5, "", "", None), ("r", "ui/app.ts", 5, "", "", None), ("r", "framework/build.gradle", 5, "", "", None)]
    got = {r["area"]: (r["profile"], r["files"]) for r in scan.plan_areas(files(spark, rows)).collect()}
    assert got == {"backend": ("spring", 2), "ui": ("frontend", 2), "framework": ("java-library", 1)}
    assert "backend -> spring (2 files" in scan.format_analysis(scan.plan_areas(files(spark, rows)), files(spark, rows)).first()["text"]
    assert scan.repo_type(scan.plan_areas(files(spark, rows))).first()["repo_type"] == "mixed-monorepo"


def test_nested_areas(spark):
    rows = [(r, p, 10, "", "", None) for r, p in [
        ("a", "apps/one/pom.xml"), ("a", "apps/one/sub/pom.xml"), ("a", "apps/one/src/A.java"), ("a", "apps/two/web/vite.config.mts"), ("a", "apps/two/web/x/build/b.js"), ("a", "ui/x.ts"),
        ("a", "ui/deep/package.json"), ("b", "x/y.py"), ("b", "z.py"), ("c", "package.json"), ("c", "ui/a.ts"), ("d", "m/src/main/java/p/A.java"), ("d", "node_modules/q/package.json"), ("e", None)]]
    got = {(r["repo_id"], r["area"]): (r["profile"], r["files"], r["reason"]) for r in scan.plan_areas(files(spark, rows)).collect()}
    assert got == {
        ("a", "apps/one"): ("java-library", 3, "Detected java-project, maven"), ("a", "apps/two/web"): ("frontend", 0, "Detected vite"), ("a", "ui"): ("frontend", 2, "Detected conventional ui/ area."),
        ("a", "ui/deep"): ("frontend", 1, "Detected node-ui"), ("b", ""): ("generic", 2, "No framework markers found; using generic source profile."), ("c", ""): ("frontend", 2, "Detected node-ui"),
        ("d", "m/src/main"): ("spring", 1, "Detected spring-layout"),
    }
    types = {r["repo_id"]: r["repo_type"] for r in scan.repo_type(scan.plan_areas(files(spark, rows))).collect()}
    assert types == {"a": "mixed-monorepo", "b": "generic-codebase", "c": "frontend-ui", "d": "spring-backend"}


def test_folder_batches(spark):
    rows = [(r, p, 10, "", "", None) for r, p in [("a", "z.py"), ("a", "b/c/d/e.py"), ("a", "b/c/x.bin"), ("a", ".x/a.py"), ("a", "b/build/a.py"), ("a", "b-1/q.py"), ("a", "b/a.py"), ("b", "q.bin")]]
    got = [(r["repo_id"], r["folder"], r["files"], r["batch"]) for r in scan.folder_batches(files(spark, rows)).orderBy("repo_id", "batch").collect()]
    assert got == [("a", "", 1, 1), ("a", "b", 1, 2), ("a", "b/c/d", 1, 3), ("a", "b-1", 1, 4), ("b", "", 0, 1)]


def test_line_windows(spark):
    def spans(n):
        df = spark.createDataFrame([("\n".join(f"l{i}" for i in range(n)),)], "t string")
        return [(w["start_line"], w["end_line"]) for w in df.select(chunking.line_windows(F.col("t")).alias("w")).first()["w"]]

    assert spans(2) == [] and spans(60) == [(1, 60), (51, 60)] and spans(100) == [(1, 60), (51, 100)]


def test_python_declarations(spark):
    text = "import os\n\n@deco\ndef a(x):\n    y = x\n    return y\n\nclass B:\n    def m(self):\n        a = 1\n        return a\n\ndef t(): pass\n"
    huge = "def big():\n" + "".join(f"    x{i} = {i}\n" for i in range(200))
    rows = [("r", "a.py", 1, text, "", "python"), ("r", "h.py", 1, huge, "", "python"), ("r", "bad.py", 1, "def (:\n\n\n", "", "python"), ("r", "e.py", 1, "", "", "python")]
    got = {r["id"]: r for r in chunking.python_chunks(files(spark, rows)).collect()}
    assert set(got) == {"r:a.py:4-6", "r:a.py:8-11", "r:h.py:1-60", "r:h.py:51-110", "r:h.py:101-160", "r:h.py:151-201"}
    assert got["r:a.py:8-11"]["chunk_type"] == "ClassDef"
    assert "bad.py" in {r["file_path"] for r in chunking.chunk_files(files(spark, rows)).collect()}


def test_bm25_against_loop(spark):
    random.seed(1)
    docs = [(i, " ".join(random.choice("apple pear plum fig nut".split()) for _ in range(random.randint(0, 12)))) for i in range(40)] + [(40, None)]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id bigint, text string"))
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in lexical.score(index, lexical.query_terms(spark, ["apple apple fig", "zzz"])).collect()}
    tokens = [(t or "").split() for _, t in docs]
    n, avg = len(docs), sum(map(len, tokens)) / len(docs)
    for d, words in enumerate(tokens):
        want = 0.0
        for q in ("apple", "apple", "fig"):
            tf, df = words.count(q), sum(q in w for w in tokens)
            if tf:
                want += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
        assert abs(got.get((0, d), 0.0) - want) < 1e-9
    assert lexical.padded(index, lexical.query_terms(spark, ["zzz"]), 5).count() == 5
    again = lexical.score(index.stored(), lexical.query_terms(spark, ["apple apple fig", "zzz"])).collect()
    assert {k: round(v, 9) for k, v in got.items()} == {(r["query_id"], r["doc_id"]): round(r["score"], 9) for r in again}


def test_cosine_blocks_against_numpy(spark):
    r = np.random.default_rng(0)
    m = r.standard_normal((60, 8)).astype(np.float32)
    m[7] = m[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "vec_id bigint, embedding array<float>")
    got = vectors.cosine_top_k(df.where("vec_id % 20 = 0"), df, 4).orderBy("query_id", "rank").collect()
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = unit @ unit[q]
        s[q] = -9
        want = sorted(range(60), key=lambda i: (-round(s[i], 9), i))[:4]
        assert [x["vec_id"] for x in got if x["query_id"] == q] == want


def test_merge_against_fold(spark):
    random.seed(3)
    for _ in range(3):
        lit = [("f", random.randint(0, 40), f"g{i}", random.choice([1.0, 2.0]), i) for i in range(12)]
        sem = [("f", random.randint(0, 40), f"s{i}", random.random(), i) for i in range(12)]
        want = {}
        for f, line, i, score, _o in lit:
            k = line // 15 * 15
            if k not in want or score > want[k][1]:
                want[k] = (i, score)
        for f, line, i, score, _o in sem:
            k = line // 15 * 15
            want[k] = (i, want[k][1] + 0.5 * score) if k in want else (i, score)
        schema = "file_path string, start_line int, id string, score double, ord int"
        got = retrieval.merge_spans(spark.createDataFrame(lit, schema), spark.createDataFrame(sem, schema)).collect()
        assert {r["bucket"]: (r["id"], round(r["score"], 9)) for r in got} == {k: (i, round(s, 9)) for k, (i, s) in want.items()}


def test_grep(spark):
    df = spark.createDataFrame([("a.py", "x\nTODO cache\nb\ncache"), ("b.py", "\n".join(["cache"] * 30))], "file_path string, content string")
    got = retrieval.grep(retrieval.file_lines(df), ["cache", " ", "todo"]).collect()
    assert sum(r["file_path"] == "b.py" for r in got) == 15
    assert {(r["line_number"], r["term"]) for r in got if r["file_path"] == "a.py"} == {(2, "cache"), (4, "cache")}
    windows = retrieval.grep_windows(retrieval.grep(retrieval.file_lines(df), ["cache", "todo"]), df)
    assert windows.where("file_path = 'a.py'").first()["end_line"] == 4
    assert retrieval.grep(retrieval.file_lines(df), []).count() == 0


def test_diversity_and_rerank(spark):
    rows = [("a.py", None, "def cache(): pass", 1.0, 0), ("a.py", "cache", "x", 1.0, 1), ("test_b.py", None, "cache", 1.0, 2), ("c.py", None, "zzz", 1.0, 3)]
    df = spark.createDataFrame(rows, "file_path string, name string, content string, score double, ord int")
    got = retrieval.rerank(df, "cache", ["cache"], 4).collect()
    assert got[0]["ord"] == 0 and got[-1]["ord"] == 3
    assert [r["score"] for r in retrieval.diversified(df).orderBy("ord").collect()] == [1.0, 1 / 1.5, 1.0, 1.0]


def test_filter_dictionary(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "x int, y string")
    assert df.where(retrieval.compile_filter({"$and": [{"y": "a"}, {"$or": [{"x": 1}, {"x": 2}]}]})).count() == 1
    assert df.where(retrieval.compile_filter({"$gt": 3})).count() == 3


def test_packing_budget(spark):
    rows = [(0, i, "a" * n) for i, n in enumerate([300, 300, 3000, 30])]
    got = context.pack(spark.createDataFrame(rows, "query_id int, rank int, content string"), room=F.lit(400)).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [0, 1, 2] and got[2]["packed"].startswith("a" * 600) and "truncated" in got[2]["packed"]
    exact = context.pack(spark.createDataFrame([(0, 0, "a" * 960), (0, 1, "a" * 3000)], "query_id int, rank int, content string"), room=F.lit(400))
    assert exact.count() == 1


def test_history_against_loop(spark):
    random.seed(5)
    rows = [(c, t, "user", "x" * random.randint(0, 900)) for c in range(20) for t in range(random.randint(1, 9))]
    got = context.trim_history(spark.createDataFrame(rows, "conv_id int, turn int, role string, content string"), max_tokens=1500)
    got = {(r["conv_id"], r["turn"]) for r in got.collect()}
    want = set()
    for c in range(20):
        turns = [(t, len(x)) for cc, t, _, x in rows if cc == c]
        while turns and sum(n for _, n in turns) // 3 > int((1500 - 1024) * 0.8):
            turns = turns[2:]
        want |= {(c, t) for t, _ in turns}
    assert got == want


def test_relevant_lines(spark):
    text = "\n".join(f"line {i}" for i in range(30)) + "\nneedle here\n" + "\n".join(f"tail {i}" for i in range(30))
    df = spark.createDataFrame([(text,), ("a\nb",), ("",)], "t string")
    got = [r[0] for r in df.select(context.relevant_lines(F.col("t"), F.array(F.lit("needle")))).collect()]
    assert got[0].split("\n") == ["    # ...", "line 27", "line 28", "line 29", "needle here", "tail 0", "tail 1", "tail 2", "    # ..."]
    assert got[1:] == ["a\nb", ""]


def test_store(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, ord int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "id string, ord int")
    assert {tuple(r) for r in store.upsert(old, new).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert [r["id"] for r in store.not_stored(new, old).collect()] == ["c"]
    rows = spark.createDataFrame([("a", "r", [1.0]), ("b", None, []), ("c", "s", None)], "id string, repo_id string, embedding array<float>")
    assert {r["id"] for r in store.delete_repo(rows, "r").collect()} == {"b", "c"}
    assert [r["id"] for r in store.with_vector(rows).collect()] == ["a"]


def test_hash_snapshots(spark, tmp_path):
    path = str(tmp_path / "state")
    assert store.read_snapshot(spark, path).count() == 0
    first = files(spark, [("r", "a", 1, "x", "1", None), ("r", "b", 1, "y", None, None), ("r", "n", 1, None, None, None)])
    store.write_snapshot(first, path)
    second = files(spark, [("r", "a", 1, "x", "2", None), ("r", "b", 1, "y", "95cb0bfd2977c761298d9624e4b4d4c72a39974a", None), ("r", "c", 1, "z", "3", None)])
    assert {r["relative_path"] for r in scan.changed_files(second, store.read_snapshot(spark, path)).collect()} == {"a", "c"}
    store.write_snapshot(second, path)
    assert scan.changed_files(second, store.read_snapshot(spark, path)).count() == 0


def test_running_numbers_against_loop(spark):
    random.seed(2)
    rows = [(random.choice("ab"), i, random.randint(0, 40) * 1_000_000) for i in range(700)]
    df = spark.createDataFrame([(g, i, v) for g, i, v in rows], "g string, event_id int, at bigint").selectExpr("g", "event_id", "timestamp_micros(at) AS ts")
    got = {(r["g"], r["nth"]): r["rate"] for r in store.rolling_rate(df, "g", window=30, every=7).collect()}
    for g in "ab":
        own = sorted((v, i) for x, i, v in rows if x == g)
        want = {}
        for nth in range(7, len(own) + 1, 7):
            first = max(nth - 29, 1)
            seconds = (own[nth - 1][0] - own[first - 1][0]) / 1e6
            want[nth] = (nth - first) / seconds if seconds else None
        assert {n: v for (x, n), v in got.items() if x == g} == want
    times = spark.createDataFrame([("r", i, float(i % 5)) for i in range(300)], "run string, at int, seconds double")
    etas = [r["eta"] for r in store.folder_eta(times, "at", "seconds").orderBy("at").collect()]
    assert etas[0] is None and all(abs(etas[i] - (300 - i) * sum(k % 5 for k in range(i)) / i) < 1e-6 for i in range(1, 300))
