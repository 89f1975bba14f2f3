"""The rate of a journal's rows, counted without a look at all its times."""

import time

import pandas as pd

from memspark.streaming import capture as cp


class Kept:
    def __init__(self):
        self.v, self.m = None, {}

    exists = lambda self: self.v is not None
    get = lambda self: self.v
    containsKey = lambda self, k: k in self.m
    getValue = lambda self, k: self.m[k]

    def update(self, v):
        self.v = v

    def updateValue(self, k, v):
        self.m[k] = v


def test_large_batches_take_time_in_proportion():
    n, c = 12_000, cp.Capture(4, 300)
    c.head, c.recent, c.seen = Kept(), Kept(), Kept()
    start = time.process_time()
    parts = [pd.DataFrame({"id": range(a, n, 2), "ts": [i * 40 // 3 * 7 % 500_000 for i in range(a, n, 2)], "raw_type": "message", "text": [f"t{i}" for i in range(a, n, 2)]}) for a in (0, 1)]
    got = pd.concat(x for p in parts for x in c.handleInputRows(("u", "user"), iter([p]), None))
    assert time.process_time() - start < 5
    assert len(got) == n and set(got["verdict"]) <= {"captured", "limited"}
