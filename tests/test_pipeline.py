import numpy as np
import pytest

from lodestrata.operators import context, lexical, pipeline, vectors

CHUNK = "ord bigint, id string, file_path string, language string, start_line int, end_line int, chunk_type string, name string, context_header string, content string"


@pytest.fixture(scope="module")
def corpus(spark):
    texts = {
        "src/auth.py": "def login(user):\n    token = sign(user)\n    return token\n", "src/retry.py": "def retry_call(f):\n    while True:\n        f()\n",
        "test/test_auth.py": "def test_login():\n    assert login('a')\n    # token\n", "docs/readme.md": "login and token\n", "src/empty.py": "",
    }
    files = spark.createDataFrame([*texts.items(), ("src/none.py", None)], "file_path string, content string")
    rows = [(i, f"c{i}", p, "python", 1, 3, "FunctionDef", None if i else "login", "x", t) for i, (p, t) in enumerate(texts.items())]
    chunks = spark.createDataFrame(rows, CHUNK)
    index = lexical.build_index(chunks, "ord", "content")
    own = chunks.select("ord", vectors.embed("content").alias("embedding"))
    return pipeline.Corpus(files, chunks, index, own, lambda q: vectors.hashed_embeddings([q])[0].tolist())


def test_fallback_plans(spark):
    assert pipeline.analyse("where does the login check tokens").search_terms == ["where", "login", "check"]

    def broken(prompt):
        raise OSError

    assert pipeline.analyse("a question", broken).reasoning == "fallback"
    given = pipeline.analyse("q", lambda p: '```json\n{"search_terms": ["a", "b", "c", "d", "e", "f"], "task": "debug"}\n```')
    assert given.search_terms == list("abcde") and given.task == "debug" and given.semantic_query == "q"
    plan = pipeline.understand(spark, "how does getUserById in the authentcation svc work", [{"role": "user", "content": "x" * 300}])
    assert plan.literal_terms[0] == "getUserById" and "authentication service" in plan.corrected and plan.is_conversational
    seen = []
    plan = pipeline.understand(spark, "find it", [{"role": "user", "content": "y" * 300}], lambda p: seen.append(p) or {"reformulated": "find login", "query_variants": ["a", "b", "find it"]})
    assert plan.variants == ["find login", "a", "b", "find it"] and "USER: " + "y" * 200 + "\n" in seen[0]


def test_run_pipeline(corpus):
    plan, found = pipeline.run_pipeline(corpus, "where is login token", 3)
    rows = found.orderBy("rank").collect()
    assert len(rows) == 3 and rows[0]["file_path"] == "src/auth.py" and plan.task == "general"
    # the literal search looks into code only, and its window is replaced by the chunk that starts in the same lines
    assert all(r["file_path"] != "docs/readme.md" or r["chunk_type"] != "grep_match" for r in rows)
    shown = pipeline.prompt_of(found, plan).first()
    assert shown["context"].startswith("# Code context from 3 file(s)\n### ") and shown["context"].rstrip().endswith("```") and "where is login token" in shown["user"]
    assert shown["context"].index("test/test_auth.py") < shown["context"].index("src/auth.py")


def test_strategies_and_no_context(spark, corpus):
    plan = pipeline.Plan("login token", "login token", ["login"], literal_terms=["login"], variants=["login token", "sign user"], hypothetical_answer="def login(user): return token")
    found = pipeline.rag_chunks(corpus, plan, 2).orderBy("rank").collect()
    assert len(found) == 2 and found[0]["file_path"] == "src/auth.py"
    lexical_only = pipeline.multi_strategy_scores(pipeline.Corpus(corpus.files, corpus.chunks, corpus.index), plan, 2)
    assert lexical_only.count() == 5
    nothing = corpus.filtered(pipeline.F.col("language") == "none")
    _, none = pipeline.run_pipeline(nothing, "zz yy", 2)
    row = pipeline.prompt_of(none, pipeline.Plan("zz yy", "zz yy")).first()
    assert row["context"] is None and row["user"].startswith("(The index holds no code")


def test_compression_and_grounding(spark):
    rows = [(i, "x" * 500, None) for i in range(5)] + [(5, "short", None)]
    df = spark.createDataFrame(rows, "rank int, content string, context_header string")
    got = {r["rank"]: (len(r["content"]), r["context_header"]) for r in context.compress_chunks(df, lambda q, c: "y" * 30, "q").collect()}
    assert got[0] == (30, " [compressed]") and got[3] == (500, None) and got[5] == (5, None) and len(got) == 6
    answers = spark.createDataFrame([("q", "def load_user(): pass", "call load_user then dropTable"), ("q", "x", "nothing named")], "question string, context string, answer string")
    found = context.faithfulness(answers).collect()
    assert found[0]["unsupported"] == ["dropTable"] and found[0]["is_faithful"] and found[1]["confidence"] == 1.0


def test_inverted_file_recall(spark):
    r = np.random.default_rng(1)
    centres = r.standard_normal((30, 16))
    points = (centres[r.integers(0, 30, 3000)] + 0.4 * r.standard_normal((3000, 16))).astype(np.float32)
    points[: 1000] = points[0] + 0.01 * r.standard_normal((1000, 16)).astype(np.float32)  # a third in one cell
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(9000, None)], "vec_id bigint, embedding array<float>")
    asked = df.where("vec_id % 20 = 0")
    exact = {(x["query_id"], x["vec_id"]) for x in vectors.cosine_top_k(asked, df, 5).collect()}
    found = {(x["query_id"], x["vec_id"]) for x in vectors.VectorIndex(df, sample=1000).search(asked, 5).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    assert vectors.VectorIndex(df.where("vec_id < 0")).search(df.where("vec_id < 0"), 5).count() == 0


def test_index_is_pruned_and_ranked_early(spark):
    docs = spark.createDataFrame([(i, f"word{i % 50} common") for i in range(400)], "doc_id bigint, text string")
    index = lexical.build_index(docs).stored()
    found = lexical.search(index, lexical.query_terms(spark, ["word3 common", "word7"]), 5)
    plan = found._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "In(term" in plan
    assert found.where("query_id = 1").count() == 5
    first = lexical.warm_index(docs, "t", "1")
    assert lexical.warm_index(docs, "t", "1") is first and lexical.warm_index(docs, "t", "2") is not first
