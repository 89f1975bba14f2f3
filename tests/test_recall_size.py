"""Hits of one query are very many, so they are never shuffled by their query alone."""

from pyspark.sql import functions as F

from memspark.operators import recall as rc


def test_bounds_go_to_the_hits(spark):
    hits = spark.createDataFrame([("q", i, float(i)) for i in range(5)], "query_id string, id long, a double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = rc._lifted(hits, F.col("a"))
        assert "SortMergeJoin" not in df._jdf.queryExecution().sparkPlan().toString()
        assert {r.id: round(r._lift, 6) for r in df.collect()} == {i: round(1 + 0.3 * i / 4, 6) for i in range(5)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_a_category_is_never_shuffled_by_its_query(spark):
    nodes = spark.createDataFrame([(i, "promo" if i < 6 else "lone", f"c{i}", 1.0, 0) for i in range(7)], "node_id long, node_type string, content string, confidence double, created_at long")
    queries = spark.createDataFrame([("q", "list all promo"), ("r", "list all lone")], "query_id string, query string")
    df = rc.exhaustive(nodes, queries)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
    assert sorted((r.query_id, r.native_id) for r in df.collect()) == [("q", i) for i in range(6)]
