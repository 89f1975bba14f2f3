"""Streams over small files, run to the end."""

import datetime as dt

from pyspark.sql import functions as F

from memspark.streaming import events as ev

SCHEMA = "user_id string, id long, score double, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def write(spark, path, rows):
    spark.createDataFrame([(u, i, s, T0 + dt.timedelta(minutes=m)) for u, i, s, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_sessions_end_after_the_gap(spark, tmp_path):
    for rows in ([("u", 1, 0.1, 0), ("u", 2, 0.1, 20)], [("u", 3, 0.1, 80)], [("x", 9, 0.1, 600)], [("x", 10, 0.1, 601)]):
        write(spark, tmp_path / "in", rows)
    got = run(spark, ev.session_counts(ev.tail(spark, str(tmp_path / "in"), SCHEMA)), tmp_path, "sessions_t")
    assert sorted((r.user_id, r.n) for r in got)[:2] == [("u", 1), ("u", 2)]


def test_copies_within_the_watermark_go(spark, tmp_path):
    write(spark, tmp_path / "in", [("u", 1, 0.1, 0), ("u", 1, 0.1, 3), ("u", 2, 0.1, 4)])
    write(spark, tmp_path / "in", [("u", 1, 0.1, 5)])
    got = run(spark, ev.deduplicated(ev.tail(spark, str(tmp_path / "in"), SCHEMA), ["user_id", "id"]), tmp_path, "dedup_t")
    assert sorted(r.id for r in got) == [1, 2]


def test_gate_learns_by_user(spark, tmp_path):
    write(spark, tmp_path / "in", [("u", 1, 0.5, 0), ("u", 2, 0.0, 1), ("x", 1, 0.3, 0)])
    src = ev.tail(spark, str(tmp_path / "in"), SCHEMA).select("user_id", "id", "score")
    got = {(r.user_id, r.id): (round(r.threshold, 6), r.passes) for r in run(spark, ev.adaptive_gate(src), tmp_path, "gate_t")}
    assert got == {("u", 1): (0.4, True), ("u", 2): (0.41, False), ("x", 1): (0.4, False)}


def test_source_claims_a_late_capture(spark, tmp_path):
    write(spark, tmp_path / "a", [("h", 1, 0.0, 10), ("h", 2, 0.0, 40)])
    write(spark, tmp_path / "b", [("h", 7, 0.0, 0)])
    a = ev.tail(spark, str(tmp_path / "a"), SCHEMA).select(F.col("user_id").alias("capture_hash"), F.col("id").alias("l0_id"), F.col("ts").alias("capture_ts"))
    b = ev.tail(spark, str(tmp_path / "b"), SCHEMA).select(F.col("user_id").alias("source_hash"), F.col("id").alias("msg_id"), F.col("ts").alias("source_ts"))
    assert [(r.l0_id, r.msg_id) for r in run(spark, ev.claimed(a, b), tmp_path, "claim_t")] == [(1, 7)]
