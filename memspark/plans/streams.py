"""Named queries that run streams over the given tables to their end, each with the DuckDB SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..lineage import shared_folder
from ..sources import adapters as ad
from ..sources.adapters import with_sql
from ..streaming import capture as cp
from .queries import query

#: Rows of a journal within so many seconds.
MOST, WINDOW = 4, 300


@query(
    "captured_journal",
    with_sql(
        f""", j AS (SELECT id, ts, user_id, layer, raw_type, CASE WHEN id % 4 = 3 THEN 'ok' ELSE text END AS text FROM journal),
r AS (SELECT *, count(*) OVER (PARTITION BY user_id, layer ORDER BY ts RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) > {MOST} AS over_rate FROM j),
f AS (SELECT *, min(CASE WHEN NOT over_rate THEN ts * 1000000000 + id END) OVER (PARTITION BY user_id, layer, text) AS first FROM r),
v AS (SELECT *, CASE WHEN first = ts * 1000000000 + id THEN 'captured' WHEN first < ts * 1000000000 + id THEN 'copy' ELSE 'limited' END AS verdict FROM f),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, layer ORDER BY ts, id) - 1 AS n FROM v WHERE verdict = 'captured'),
chain AS (SELECT id, user_id, layer, n, '' AS before, sha256('|' || raw_type || '|' || ts::varchar || '|' || text)[:16] AS own FROM c WHERE n = 0
UNION ALL SELECT c.id, c.user_id, c.layer, c.n, h.own, sha256(h.own || '|' || c.raw_type || '|' || c.ts::varchar || '|' || c.text)[:16] FROM chain h JOIN c ON c.user_id = h.user_id AND c.layer = h.layer AND c.n = h.n + 1)
SELECT v.id, v.verdict, CASE WHEN v.verdict <> 'limited' THEN first % 1000000000 END AS first_id, CASE WHEN n IS NOT NULL THEN length(to_base(n, 16))::varchar || lower(to_base(n, 16)) END AS order_key, before AS hash_prev, own AS hash_self FROM v LEFT JOIN chain ON v.id = chain.id""",
        "journal",
        recursive=True,
    ),
)
def captured_journal(spark, d):
    """Conversations as a stream; every fourth message says the same."""
    cp.keyed_state(spark)
    folder = f"{shared_folder(spark).rstrip('/')}/capture-{uuid.uuid4().hex}"
    schema = ad.table(spark, d, "conversations").schema
    # A glob, so that a single file is a source like a folder.
    turns = spark.readStream.schema(schema).parquet(f"{d}/conversations.parque[t]")
    j = ad.journal_of(turns).withColumn("text", F.when(F.col("id") % 4 == 3, "ok").otherwise(F.col("text")))
    out = cp.captured(j, MOST, WINDOW).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(cp.COLUMNS).parquet(f"{folder}/out")
    return found.select("id", "verdict", "first_id", "order_key", "hash_prev", "hash_self")
