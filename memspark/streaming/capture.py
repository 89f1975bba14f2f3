"""Serialised capture of messages: one writer per journal, with its state in the stream.

A journal is what a user said in a layer. Its rows are captured one after another: copies of a text are folded into the
first, senders over their rate are turned away, and every row that stays gets the next order key and a link to the hash of
the row before. Head, seen texts (with a time to live) and recent times are keyed state of transformWithState, so a
restart goes on where the last batch ended and the chain stays whole."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of a journal within WINDOW seconds, and how long a text is remembered (ms; 0: for good).
MOST, WINDOW, REMEMBERED = 10, 60, 0
COLUMNS = "user_id string, layer string, id long, ts long, raw_type string, text string, verdict string, first_id long, order_key string, hash_prev string, hash_self string"
_DIGITS = "0123456789abcdef"


def appended_key(n: int) -> str:
    """The order key of the n-th row: its hex digits after their number, so keys sort as text and stay short."""
    digits = f"{n:x}"
    return _DIGITS[len(digits)] + digits


def key_between(a: str | None, b: str | None) -> str:
    """A key after a and before b (None: no bound), for rows put in later. Keys are hex digits that don't end in 0.

    Reads a and b as fractions and takes digits of their middle until the key lies between."""
    low, high = a or "", b
    if high is not None and low >= high:
        raise ValueError(f"no key between {a!r} and {b!r}")
    out, bounded = "", high is not None
    for i in range(max(len(low), len(high or "")) + 2):
        x = _DIGITS.index(low[i]) if i < len(low) else 0
        y = _DIGITS.index(high[i]) if bounded and i < len(high) else (0 if bounded else 16)
        if y - x > 1:
            return out + _DIGITS[(x + y) // 2]
        out += _DIGITS[x]
        # One digit below: what follows is free upwards.
        bounded = bounded and x == y
    raise ValueError(f"no key between {a!r} and {b!r}")


def digest(before: str, raw_type: str, ts: int, text: str) -> str:
    return hashlib.sha256(f"{before}|{raw_type}|{ts}|{text}".encode()).hexdigest()[:16]


class Capture(StatefulProcessor):
    """Rows of one journal, by time and id within a batch. Verdicts: captured, copy (of first_id), limited (over the rate)."""

    def __init__(self, most: int = MOST, window: int = WINDOW, remembered: int = REMEMBERED):
        self.most, self.window, self.remembered = most, window, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "n long, hash string")
        self.recent = handle.getValueState("recent", "times array<long>")
        self.seen = handle.getMapState("seen", "hash string", "id long", self.remembered or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
        n, before = self.head.get() if self.head.exists() else (0, "")
        times = list(self.recent.get()[0]) if self.recent.exists() else []
        # Times of this batch count for all rows of their second.
        times = sorted(times + [int(t) for t in batch["ts"]])
        out = []
        for row in batch.itertuples(index=False):
            ts, text = int(row.ts), row.text if isinstance(row.text, str) else ""
            name = (hashlib.sha256(text.encode()).hexdigest(),)
            lately = bisect_right(times, ts) - bisect_right(times, ts - self.window)
            if self.seen.containsKey(name):
                out.append((*key, row.id, ts, row.raw_type, text, "copy", self.seen.getValue(name)[0], None, None, None))
            elif lately > self.most:
                out.append((*key, row.id, ts, row.raw_type, text, "limited", None, None, None, None))
            else:
                own = digest(before, row.raw_type, ts, text)
                out.append((*key, row.id, ts, row.raw_type, text, "captured", row.id, appended_key(n), before, own))
                self.seen.updateValue(name, (int(row.id),))
                n, before = n + 1, own
        self.head.update((n, before))
        last = max(times)
        self.recent.update(([t for t in times if t > last - self.window],))
        found = pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])
        yield found.astype({"first_id": "Int64"})

    def close(self) -> None:
        pass


def captured(messages: DataFrame, most: int = MOST, window: int = WINDOW, remembered: int = REMEMBERED) -> DataFrame:
    """A stream of messages (user_id, layer, id, ts in seconds, raw_type, text) as journal rows with verdicts. A null text is empty.

    Needs the RocksDB state store (see keyed_state). A time to live needs a clock, whose timers keep a stream going, so with
    one the stream is to be run by a trigger of its own and not until its input ends."""
    narrow = messages.select("user_id", "layer", "id", F.col("ts").cast("long").alias("ts"), "raw_type", "text")
    return narrow.groupBy("user_id", "layer").transformWithStateInPandas(Capture(most, window, remembered), COLUMNS, "Append", "ProcessingTime" if remembered else "None")


def keyed_state(spark: SparkSession) -> None:
    """Sets the state store that transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def broken_links(journal: DataFrame) -> DataFrame:
    """The captured rows whose link or hash doesn't hold: user_id, layer, id, why (link or hash)."""
    w = Window.partitionBy("user_id", "layer").orderBy("order_key")
    rows = journal.where("verdict = 'captured'").withColumn("_before", F.coalesce(F.lag("hash_self").over(w), F.lit("")))
    own = F.substring(F.sha2(F.concat_ws("|", "hash_prev", "raw_type", F.col("ts").cast("string"), "text"), 256), 1, 16)
    why = F.when(F.col("hash_prev") != F.col("_before"), "link").when(F.col("hash_self") != own, "hash")
    return rows.select("user_id", "layer", "id", why.alias("why")).where("why is not null")
