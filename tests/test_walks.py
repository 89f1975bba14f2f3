"""Conversations, miners and files on small tables with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from memspark.operators import conversation as cv
from memspark.operators import miners as mn
from memspark.sources import files as fs


def test_tool_calls_meet_their_results(spark):
    use = lambda i, name, **k: {"type": "tool_use", "id": i, "name": name, "input": k}
    end = lambda i, content, bad=False: {"type": "tool_result", "tool_use_id": i, "content": content, "is_error": bad}
    texts = [json.dumps([use("a", "grep", pattern="x y"), use("b", "grep", other="  z ")]), json.dumps(end("a", [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}])), json.dumps([end("b", "bad", True), end("zz", "lost")]), "no json", None, json.dumps([use("c", "read", query="q")])]
    j = spark.createDataFrame([(i, i * 10, t) for i, t in enumerate(texts)], "id long, ts long, text string")
    blocks = cv.tool_blocks(j)
    assert blocks.count() == 6
    pairs = {(r.tool, r.argument, r.result, r.is_error) for r in cv.tool_pairs(blocks).collect()}
    assert pairs == {("grep", "x y", "one two", False), ("grep", "z", "bad", True)}
    stats = {r.tool: (r.calls, r.errors, r.error_rate, r.mean_result) for r in cv.tool_stats(blocks).collect()}
    assert stats == {"grep": (2, 1, 0.5, 5.0), "read": (1, 0, 0.0, 0.0)}


def test_segments_turn_with_the_topic_and_stay_bounded(spark):
    same = "alpha beta gamma delta"
    rows = [(1, i, same) for i in range(12)] + [(2, 0, same), (2, 1, same), (2, 2, "other words here now"), (2, 3, "other words here now"), (3, 0, None), (3, 1, "")]
    got = {(r.c, r.t): r.segment_no for r in cv.segments(spark.createDataFrame(rows, "c long, t long, text string"), ["c"], "t").collect()}
    assert [got[1, i] for i in range(12)] == [0] * 10 + [1] * 2
    assert [got[2, i] for i in range(4)] == [0, 0, 1, 1]
    assert got[3, 0] == got[3, 1] == 0
    long = spark.createDataFrame([(1, i, "word " * 400) for i in range(3)], "c long, t long, text string")
    assert sorted(r.segment_no for r in cv.segments(long, ["c"], "t").collect()) == [0, 1, 2]
    assert cv.segments(long.limit(0), ["c"], "t").count() == 0


def test_stranded_rows_need_evidence_of_their_scope(spark):
    j = spark.createDataFrame([(1, "user", "u", 0), (2, "user", "u", 0), (3, "user", "u", 0), (4, "user", "u", 990)], "id long, layer string, user_id string, ts long")
    f = spark.createDataFrame([("user", "u", 1), ("agent", "u", 3)], "layer string, user_id string, source_raw_id long")
    e = spark.createDataFrame([("user", "u", ["raw:2", "raw:x", "tag"]), ("user", "v", ["raw:3"])], "layer string, user_id string, tags array<string>")
    assert {r.id: r.verdict for r in cv.stranded(j, f, e, 1000).collect()} == {1: "promoted_l4", 2: "saved_l3", 3: "unaccounted"}


def test_proposals_are_absorbed(spark):
    p = spark.createDataFrame([("k", 10, "a"), ("k", 20, "b"), ("x", 50, "c"), ("x", 500, "d"), ("y", 1, "e")], "key string, at long, payload string")
    gone = spark.createDataFrame([("x", 40), ("y", 5)], "key string, at long")
    got = {r.key: (r.first_at, r.at, r.payload, r.n) for r in cv.pending(p, gone, ["key"], 100).collect()}
    assert got == {"k": (10, 20, "b", 2), "x": (500, 500, "d", 1), "y": (1, 1, "e", 1)}


def test_traces_end_in_loops(spark):
    e = spark.createDataFrame([("a", "b", "caused", 0.5), ("b", "a", "led_to", 0.5), ("b", "c", "prevented", 0.1), ("a", "d", "likes", 1.0), ("a", "b", "led_to", 0.9)], "source_id string, target_id string, relation string, weight double")
    got = [(r.node, r.relation, r.depth) for r in mn.trace(e, spark.createDataFrame([("a",)], "node string"), 5).orderBy("depth").collect()]
    assert got == [("b", "led_to", 1), ("c", "prevented", 2)]


def test_two_cliques_are_two_communities(spark):
    clique = lambda names: [(a, b, 1.0) for a in names for b in names if a < b]
    e = spark.createDataFrame(clique("abcd") + clique("wxyz") + [("d", "w", 0.1)], "source_id string, target_id string, weight double")
    got = {r.node: r.community for r in mn.communities(e).collect()}
    assert len({got[n] for n in "abcd"}) == len({got[n] for n in "wxyz"}) == 1 and got["a"] != got["z"]


def test_bridges_equal_a_plain_search(spark):
    texts = {"a": "one two three four", "b": "one two three four", "c": "one two three five", "d": "red blue green", "e": "red blue green grey", "f": "", "g": "lone wolf here"}
    nodes = spark.createDataFrame([(k, v, "fact") for k, v in texts.items()], "node_id string, content string, node_type string")
    edges = spark.createDataFrame([("g", "b")], "source_id string, target_id string")
    want = set()
    for x in "acdef":
        near = [(len(p & q) / len(p | q), y) for y in texts if y != x and (p := set(texts[x].split())) and (q := set(texts[y].split()))]
        best = max((s for s, _ in near), default=0)
        if best >= 0.6:
            y = min(y for s, y in near if s == best)
            want.add((min(x, y), max(x, y), round(best * 0.3, 6)))
    assert {(r.source_id, r.target_id, round(r.weight, 6)) for r in mn.bridges(nodes, edges, 0.6).collect()} == want


def test_similarity_by_length(spark):
    rows = [("abcdefgh", "abcdefgh"), ("", "x"), ("word " * 30, "word " * 30), ("alpha beta " * 50, "gamma delta " * 50), ("ab", "ab")]
    got = [r.s for r in spark.createDataFrame(rows, "a string, b string").select(mn.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and 0.6 < got[2] <= 1.0 and got[3] < 0.3 and got[4] == 0.0


def test_chat_exports(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(x if isinstance(x, str) else json.dumps(x)) and str(tmp_path / name)
    c = put("c.json", [{"messages": [{"role": "human", "content": "hi", "created_at": "2024-01-01T00:00:10Z"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, "b"]}]}])
    assert [(r.role, r.text, r.ts) for r in fs.records(spark, "claude", c).collect()] == [("human", "hi", 1704067210.0), ("assistant", "a b", None)]
    g = put("g.json", [{"mapping": {"1": {"message": {"author": {"role": "user"}, "content": {"parts": ["x", "y"]}, "create_time": 5.5}}, "2": {"message": None}, "3": {"message": {"author": {"role": "system"}, "content": {"parts": ["s"]}}}}}])
    assert [(r.role, r.text, r.ts) for r in fs.records(spark, "chatgpt", g).collect()] == [("user", "x y", 5.5)]
    m = put("m.json", [{"key": "k", "value": "v", "ts": 7}])
    assert [(r.role, r.text, r.ts) for r in fs.records(spark, "memory-json", m).collect()] == [(None, "k: v", 7.0)]
    line = put("l.jsonl", '{"role": "user", "message": "m"}\n{"text": "t", "ts": "bad"}\n')
    assert [(r.role, r.text, r.ts) for r in fs.records(spark, "jsonl", line).collect()] == [("user", "m", None), (None, "t", None)]
    with pytest.raises(ValueError, match="unknown"):
        fs.records(spark, "none", c)


def test_markdown_round_trip(spark, tmp_path):
    (tmp_path / "plain.md").write_text("just text\n")
    (tmp_path / "full.md").write_text("---\ntitle: \"A title\"\nwiki_type: skill\ntags:\n- one\n- two\nimportance: x\nstatus: Stale\n---\n\n# Body\nmore\n")
    got = {r.path.rsplit("/", 1)[1]: r for r in fs.markdown(spark, str(tmp_path)).collect()}
    p, f = got["plain.md"], got["full.md"]
    assert (p.title, p.wiki_type, p.tags, p.importance, p.status, p.content) == ("plain", "note", [], 0.5, "active", "just text")
    assert (f.title, f.wiki_type, f.tags, f.importance, f.status, f.content) == ("A title", "skill", ["one", "two"], 0.5, "stale", "# Body\nmore")
    rows = fs.markdown(spark, str(tmp_path))
    again = fs.parsed_markdown(rows.select("path", fs.to_markdown(rows).alias("value")))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


def test_html_becomes_markdown(spark):
    html = "<html><style>x</style><h1>T</h1><p>a &amp; b</p><ul><li>i</li></ul></html>"
    out = spark.createDataFrame([(html,), (None,)], "h string").select(fs.html_to_markdown(F.col("h")).alias("m")).collect()
    assert [r.m for r in out] == ["# T\n\na & b\n\n- i", ""]
