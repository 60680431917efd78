from lodestrata import cli
from lodestrata.sources.tree import ignore_rules, read_raw, read_tree, repo_roots
from lodestrata.streaming.incremental import apply_batch, index_stream, read_index


def test_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/__init__.py").write_text("x = 1\n")
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "node_modules/big.js").write_text("x")
    (tmp_path / ".gitignore").write_text("*.pyc\n\n# no\n")
    got = {r["relative_path"]: r for r in read_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/__init__.py", "src/bad.py", ".gitignore"}
    assert got["src/__init__.py"]["size_bytes"] == 6 and ignore_rules(str(tmp_path)) == ["*.pyc"]


def test_tree_tasks_and_sizes(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"d{k}/e{k}/f").mkdir(parents=True)
        (tmp_path / f"d{k}/e{k}/f/x.py").write_text("y" * (100 * k))
        (tmp_path / f"d{k}/a.txt").write_text("1")
    for tasks in (1, 5, 500):
        got = {r["relative_path"]: r for r in read_tree(spark, str(tmp_path), tasks=tasks, max_kb=1).collect()}
        assert len(got) == 24 and got["d11/e11/f/x.py"]["content"] is None and got["d11/e11/f/x.py"]["size_bytes"] == 1100
        assert len(got["d10/e10/f/x.py"]["content"]) == 1000
    files = read_tree(spark, str(tmp_path))
    assert read_raw(files, "d3/e3/f/x.py", 10) == "y" * 10 and read_raw(files, "none") is None
    assert repo_roots(files).first()["root"] == str(tmp_path)
    assert read_tree(spark, str(tmp_path / "nowhere")).count() == 0


def test_incremental_stream(spark, tmp_path):
    source, index, marks = (str(tmp_path / x) for x in ("in", "index", "marks"))
    shape = "repo_id string, relative_path string, language string, content string, loaded_at timestamp"

    def add(rows):
        spark.createDataFrame(rows, shape).selectExpr("*", "1L AS size_bytes").write.mode("append").parquet(source)

    from datetime import datetime

    add([("r", "a.txt", "text", "1\n2\n3\n4", datetime(2024, 1, 1)), ("r", "b.txt", "text", "1\n2\n3", datetime(2024, 1, 1))])
    index_stream(spark, source, index, marks).awaitTermination()
    assert {r["id"] for r in read_index(spark, index).collect()} == {"r:a.txt:1-4", "r:b.txt:1-3"}
    add([("r", "a.txt", "text", "1\n2\n3\n4\n5", datetime(2024, 1, 2))])
    index_stream(spark, source, index, marks).awaitTermination()
    assert {r["id"] for r in read_index(spark, index).collect()} == {"r:a.txt:1-5", "r:b.txt:1-3"}
    # a batch that comes again leaves the same, and a deleted file leaves
    rows = spark.createDataFrame([("r", "a.txt", "text", "1\n2\n3\n4\n5\n6", datetime(2024, 1, 3), 1, False), ("r", "b.txt", "text", None, datetime(2024, 1, 3), 1, True)], shape + ", size_bytes bigint, deleted boolean")
    for _ in range(2):
        apply_batch(rows, 7, index)
        assert {r["id"] for r in read_index(spark, index).collect()} == {"r:a.txt:1-6"}
    for n in range(8, 12):
        apply_batch(rows, n, index)
    assert len([x for x in (tmp_path / "index").iterdir() if x.name.startswith("batch=")]) <= 3
    assert read_index(spark, str(tmp_path / "none")).count() == 0


def test_cli(spark, tmp_path, capsys):
    repo, folder = tmp_path / "repo", str(tmp_path / "store")
    (repo / "src").mkdir(parents=True)
    (repo / "src/main.py").write_text("def login(user):\n    token = sign(user)\n    return token\n")
    (repo / "src/app.js").write_text("function greet(name) {\n  const s = name;\n  return s;\n}\n")
    (repo / "skip.log").write_text("x\n")
    (repo / "old.md").write_text("a\nb\nc\n")
    (repo / ".gitignore").write_text("*.md\n!old.md\n")
    assert "Detected type: generic-codebase" in cli.analyze(spark, str(repo))
    assert cli.index(spark, str(repo), folder) == {"changed": 3, "deleted": 0, "chunks": 3}
    assert cli.index(spark, str(repo), folder) == {"changed": 0, "deleted": 0, "chunks": 3}
    (repo / "old.md").unlink()
    (repo / "src/main.py").write_text("def login(user):\n    return sign(user)\n\n\ndef logout(user):\n    a = 1\n    return a\n")
    assert cli.index(spark, str(repo), folder) == {"changed": 1, "deleted": 1, "chunks": 2}
    found = cli.ask(spark, folder, "where is logout of the user", task="explain")
    assert "src/main.py" in found["sources"] and "logout" in found["user"] and found["max_tokens"] == 1500
    cli.main(["stats", folder])
    assert "javascript" in capsys.readouterr().out
