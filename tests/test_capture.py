"""Capture with state over batches and a restart; replay with claims and a run that is lost midway."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from memspark.operators import replay as rp
from memspark.streaming import capture as cp

SCHEMA = "user_id string, layer string, id long, ts long, raw_type string, text string"


def plain(rows, most):
    """rows in order: verdicts by id."""
    out, seen, times, heads = {}, {}, defaultdict(list), {}
    for u, layer, _, ts, *_ in rows:
        times[u, layer].append(ts)
    for u, layer, i, ts, kind, text in rows:
        k, text = (u, layer), text or ""
        if (k, text) in seen:
            out[i] = ("copy", seen[k, text], None)
        elif sum(ts - 60 < t <= ts for t in times[k]) > most:
            out[i] = ("limited", None, None)
        else:
            n, before = heads.get(k, (0, ""))
            heads[k] = (n + 1, cp.digest(before, kind, ts, text))
            seen[k, text] = i
            out[i] = ("captured", i, cp.appended_key(n))
    return out


def test_batches_and_a_restart_give_one_chain(spark, tmp_path):
    cp.keyed_state(spark)
    rng = random.Random(7)
    rows, ts = [], 1000
    for i in range(240):
        ts += rng.randrange(0, 12)
        rows.append((rng.choice("uv"), rng.choice(["user", "agent"]), i, ts, "message", rng.choice([f"text {rng.randrange(150)}", None if i % 50 == 0 else f"own {i}"])))
    source, sink, check = (str(tmp_path / k) for k in ("in", "out", "check"))
    for part in range(4):
        spark.createDataFrame(rows[60 * part : 60 * part + 60], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        # Each round is a query of its own, started from the checkpoint of the last.
        stream = cp.captured(spark.readStream.schema(SCHEMA).parquet(source), most=4)
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
    got = spark.read.parquet(sink)
    want = plain(rows, 4)
    assert {r.id: (r.verdict, r.first_id, r.order_key) for r in got.collect()} == want
    assert {v for v, *_ in want.values()} == {"captured", "copy", "limited"}
    assert cp.broken_links(got).count() == 0
    bad = got.withColumn("text", F.when(F.col("order_key") == "13", "forged").otherwise(F.col("text")))
    assert {r.why for r in cp.broken_links(bad).collect()} == {"hash"}
    assert {r.why for r in cp.broken_links(got.where("order_key is null or order_key <> '13'")).collect()} == {"link"}


def test_order_keys():
    keys = [cp.appended_key(n) for n in [*range(600), 4095, 4096, 10**9]]
    assert keys == sorted(keys)
    rng, known = random.Random(1), ["10", "11", "2ff"]
    for _ in range(300):
        at = rng.randrange(len(known) + 1)
        a, b = known[at - 1] if at else None, known[at] if at < len(known) else None
        known.insert(at, cp.key_between(a, b))
    assert known == sorted(set(known))
    with pytest.raises(ValueError, match="no key"):
        cp.key_between("5", "5")


def test_two_runs_judge_each_row_once_though_one_is_lost(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    rp.append(spark.createDataFrame([], rp.SCHEMA), folder)
    j = spark.createDataFrame([(i, 100 + i, "received" if i % 3 else "gated_out", "service" if i == 7 else None) for i in range(20)] + [(99, 100, "promoted_l4", None)], "id long, ts long, status string, raw_type string")
    ids = lambda df: sorted(r.id for r in df.collect())
    judge = lambda df, v: df.select("id", F.lit(v).alias("verdict"))
    a = rp.claim(spark, folder, j, "g", "c1", "A", 1000, most=8)
    assert ids(a) == [0, 1, 2, 3, 4, 5, 6, 8]
    rp.record(judge(a.where("id < 3"), "saved_l3"), folder, "g", "c1", "A", 1010)
    b = rp.claim(spark, folder, j, "g", "c1", "B", 1100)
    assert ids(b) == [*range(9, 20)]
    rp.record(judge(b, "promoted_l4"), folder, "g", "c1", "B", 1110)
    rp.record(judge(b, "promoted_l4"), folder, "g", "c1", "B", 1111)
    # A is lost; its lease ends, B takes over, and what A says late doesn't count.
    assert ids(rp.claim(spark, folder, j, "g", "c1", "B", 1599)) == []
    late = rp.claim(spark, folder, j, "g", "c1", "B", 1600)
    assert ids(late) == [3, 4, 5, 6, 8]
    rp.record(judge(a, "gated_out"), folder, "g", "c1", "A", 1605)
    rp.record(judge(late, "promoted_l4"), folder, "g", "c1", "B", 1610)
    got = {r.row_id: (r.verdict, r.run_id) for r in rp.verdicts(rp.ledger(spark, folder), "g", "c1").collect()}
    assert got == {i: ("saved_l3", "A") if i < 3 else ("promoted_l4", "B") for i in range(20) if i != 7}
    assert rp.claim(spark, folder, j, "g", "c1", "C", 99999).count() == 0
    assert len(ids(rp.open_rows(j, rp.ledger(spark, folder), "g", "c2", 99999))) == 19
    status = {r.id: r.status for r in rp.applied(j, rp.ledger(spark, folder), "g", "c1").collect()}
    assert status[0] == "saved_l3" and status[19] == "promoted_l4" and status[7] == "received" and status[99] == "promoted_l4"
