"""Packages written and read back: exact round trips, ZIP64, and what is read of a file."""

import base64
import hashlib
import io
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from memspark.llm import wacz

SCHEMA = "page_id long, url string, html string, package string"


def members(data):
    reads = []

    def read_at(at, n):
        reads.append((at, n))
        return data[at : at + n]

    return wacz.directory(read_at, len(data)), reads


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_finds_stored_members(zip64):
    out = io.BytesIO()
    records = [wacz.record(i, f"http://x/{i}", b"payload %d" % i, 9, "D", None) for i in range(50)]
    assert wacz.write_package(out, iter(records), zip64) == 50
    data = out.getvalue()
    found, reads = members(data)
    at, n = found[wacz.DATA]
    assert data[at : at + n] == b"".join(records)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.read(wacz.INDEX).splitlines() == data[found[wacz.INDEX][0] :][: found[wacz.INDEX][1]].splitlines()
    assert (at, n) not in reads


def test_more_entries_than_the_old_format_counts():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):
            z.writestr(f"m{i}", b"x")
    found, _ = members(out.getvalue())
    assert len(found) == 66_000 and out.getvalue()[found["m65999"][0]] == ord("x")


def test_sizes_in_the_extra_field_are_followed():
    assert wacz._extra64(b"\x01\x00\x10\x00" + (5).to_bytes(8, "little") + (1 << 40).to_bytes(8, "little"), [0xFFFFFFFF, 7, 0xFFFFFFFF]) == [5, 7, 1 << 40]
    with pytest.raises(ValueError, match="central directory"):
        members(b"not a zip file")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 99)
    with pytest.raises(ValueError, match="not stored"):
        members(out.getvalue())


def test_round_trip_with_copies_nulls_and_long_pages(spark, tmp_path):
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate(["a", "b", "a", None, "", "é😀\r\n\r\nx", "a", "long " * 50_000])]
    rows += [(None, "u", "solo"), (None, None, "a"), (9, "first", "twice"), (9, "again\r\nX: y", "twice"), (11, None, "\n")]
    manifest = wacz.write_packages(spark.createDataFrame([(*r, "p") for r in rows], SCHEMA), str(tmp_path / "w"), package_records=3)
    got = wacz.read_packages(manifest).collect()
    assert sum(r.records for r in manifest.collect()) == len(rows) == len(got) and manifest.count() > 2
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        refers = last[h or ""] if i != last[h or ""] and last[h or ""] >= 0 else None
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if refers is not None else "response", str(refers), raw if refers is None else b""))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), bytes(r.payload)) for r in got) == sorted(want)
    assert all(os.path.exists(r.path) for r in manifest.collect())
    assert {r.url for r in got} >= {"http://x/0", "again%0D%0AX: y", None}


def test_sql_agrees_where_payloads_are_equal(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", None if i % 11 == 0 else "" if i % 7 == 0 else f"page {i % 40}" * (i % 5)) for i in range(600)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = wacz.op5_wacz(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(wacz.ORACLE_SQL).df()
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(want.columns)].astype(object).where(df.notna(), None).itertuples(index=False))
    as_int = lambda df: df.assign(refers_to=df.refers_to.map(lambda v: None if v != v or v is None else str(int(v))))
    assert rows(as_int(got)) == rows(as_int(want)) and (want.record_type == "revisit").sum() > 400


def test_reading_is_spread_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wacz, "TASK_BYTES", 10_000)
    monkeypatch.setattr(wacz, "RANGE_RECORDS", 20)
    pages = spark.range(3000).selectExpr("id as page_id", "'u' as url", "cast(id as string) as html")
    out = wacz.read_packages(wacz.write_packages(pages, str(tmp_path / "t"), package_records=300))
    parts = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 3000 and len(parts) > 10


def test_empty_table(spark, tmp_path):
    manifest = wacz.write_packages(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert manifest.count() == 0 and wacz.read_packages(manifest).count() == 0
