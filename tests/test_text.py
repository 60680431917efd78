from pyspark.sql import functions as F

from lodestrata.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_lines_follow_splitlines(spark):
    for text in ("", "a", "a\n", "a\r\nb\rc\n\nd", "x\x0by\x0cz\x1cq\x85w e f", "\n\n"):
        assert one(spark, T.lines(F.lit(text))) == text.splitlines()


def test_bm25_tokens(spark):
    assert one(spark, T.bm25_tokens(F.lit("getUserById order_service Ünï9"))) == ["get", "user", "by", "id", "order", "service", "n", "9"]


def test_identifier_splitting(spark):
    assert one(spark, T.camel_split(F.lit("HTTPClient getUserById"))) == "HTTP Client get User By Id"
    assert one(spark, T.snake_split(F.lit("a_b"))) == "a b"


def test_normalise_symbols(spark):
    assert one(spark, T.normalise_symbols(F.lit("@Autowired user.getName() -> Map<K,V> 3.14"))) == "Autowired user getName Map 3.14"


def test_correction(spark):
    got = one(spark, T.correct_query(F.lit("How does the authentcation svc work?")))
    assert got["corrected"] == "How does the authentication service work" and got["was_corrected"]
    assert one(spark, T.correct_query(F.lit("  ")))["corrected"] == "  "
    assert one(spark, T.correct_query(F.lit("where is getUserById and order_total")))["symbols"] == ["getUserById", "order_total"]


def test_correction_switches_and_changes(spark):
    text = F.lit("Getting the OrderRepositry svc!, user_id via ledgerManagr")
    got = one(spark, T.correct_query(text))
    assert got["corrected"] == "Getting the Order repository service user identifier via ledger Managr".replace("Order repository", "Order Repository")
    assert got["changes"] == ["identifier split", "'Repositry' → 'Repository'", "'svc' → 'service'", "'id' → 'identifier'"]
    off = one(spark, T.correct_query(text, spelling=False, abbreviations=False, identifiers=False))
    assert off["changes"] == [] and not off["was_corrected"] and off["corrected"].startswith("Getting the OrderRepositry svc")
    df = spark.createDataFrame([("call ledgrmanager now",)], "t string")
    df = df.withColumn("near", T.nearest_names(["LedgerManager", "other"])(T.normalise_symbols(F.col("t"))))
    got = df.select(T.correct_query(F.col("t"), F.col("near")).alias("q")).first()["q"]
    assert got["corrected"] == "call LedgerManager now" and got["changes"] == ["'ledgrmanager' → 'LedgerManager' (codebase symbol)"]
    assert one(spark, T.expand_abbreviations(F.lit("svc) (svc"))) == "service (svc"


def test_fuzzy_match(spark):
    match = T.fuzzy_match(["Authentication", "repository"])
    rows = spark.createDataFrame([("authentcation",), ("short",), (None,)], "w string").select(match("w").alias("x")).collect()
    assert [r["x"] for r in rows] == ["Authentication", "short", None]


def test_rough_tokens_and_terms(spark):
    assert one(spark, T.rough_tokens(F.lit("a" * 300))) == 100
    assert one(spark, T.rough_tokens(F.lit(""))) == 1
    assert one(spark, T.fallback_terms(F.lit("the quick brown foxes jumped lazily"))) == ["quick", "brown", "foxes"]
    assert one(spark, T.duration_text(F.lit(75.0))) == "1m 15s"
