"""Graph building against a plain pass over the same rows."""

import re

import pytest
from pyspark.sql import functions as F

from memspark.operators import build as bd

NODES = "node_id string, layer string, user_id string, node_type string, content string"


def plain_relations(text):
    out = []
    for between, relation, kind in bd.RELATIONS:
        for m in re.finditer(f"({bd.NAME}){between}({bd.NAME})", text or "", re.IGNORECASE):
            if all(len(x) >= 2 and x not in bd.NO_NAMES for x in m.groups()):
                out.append((m[1], relation, m[2], kind))
    return out


TEXTS = ["Anna knows Boris. Boris works at Acme, Anna knows Boris", "Иван работает в Газете и Пётр знает Ивана", "The knows Bob", "I met Clara-Maria and talked to Dora", "", None, "A1 knows B2 knows C3", "это часть Города\nEve is part\n of Team", "x" * 5000 + " knows Zed", "Сегодня встретила Олега; позвонила  с Ритой; called  Max_7"]


def test_relations_and_people_equal_plain_matching(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {r.id: ([tuple(x) for x in r.rel], r.names) for r in df.select("id", bd.relations(F.col("text")).alias("rel"), bd.people(F.col("text")).alias("names")).collect()}
    for i, t in enumerate(TEXTS):
        names = [m[1] for m in re.finditer(f"{bd.MEETING}({bd.NAME})", t or "", re.IGNORECASE) if len(m[1]) >= 2 and m[1] not in bd.NO_NAMES]
        assert got[i] == (plain_relations(t), names), t
    assert sum(len(r) for r, _ in got.values()) >= 8 and sum(len(n) for _, n in got.values()) >= 4


def test_a_graph_of_texts_adds_each_node_and_edge_once_and_again_nothing(spark):
    nodes = spark.createDataFrame([("n2", "user", "u1", "person", "Anna"), ("n1", "user", "u1", "person", "Anna"), ("n3", "agent", "u1", "person", "Boris")], NODES)
    rows = [("user", u, t, at) for u in ("u1", None) for t in TEXTS for at in (100_000, 100_000, 10)] + [("user", "u2", "Old knows Older", 10)]
    texts = spark.createDataFrame(rows, "layer string, user_id string, text string, created_at long")
    got = bd.graph_from_texts(nodes, texts, 100_100)
    edges, new = got["edges"].collect(), got["nodes"].collect()
    assert len(edges) == 2 * len({x for t in TEXTS for x in plain_relations(t)}) == len({(e.source_id, e.target_id, e.relation) for e in edges})
    assert "Old" not in {n.content for n in new} and ("u1", "Anna") not in {(n.user_id, n.content) for n in new}
    assert {e.source_id for e in edges if e.relation == "knows"} >= {"n1"} and "n2" not in {e.source_id for e in edges}
    assert len({n.node_id for n in new}) == len(new) == len({(n.user_id, n.node_type, n.content) for n in new})
    again = bd.graph_from_texts(nodes.unionByName(got["nodes"].select(nodes.columns)), texts, 100_100)
    assert again["nodes"].count() == 0 and sorted(again["edges"].collect()) == sorted(edges)
    assert bd.replaced(got["edges"], again["edges"]).count() == len(edges)
    assert bd.graph_from_texts(nodes, texts.limit(0), 100_100)["edges"].count() == 0


def test_pages_become_nodes_and_links_edges_that_do_not_replace(spark):
    nodes = spark.createDataFrame([("n1", "user", "u", "note", "a.md"), ("n9", "user", "u", "wiki_page", "old.md"), ("n8", "user", "other", "wiki_page", "far.md")], NODES)
    pages = spark.createDataFrame([("user", "u", "a.md", 0.9), ("user", "u", "b.md", 0.0), ("user", "u", "c.md", None)], "layer string, user_id string, path string, importance double")
    links = spark.createDataFrame([("a.md", "b.md", "related"), ("a.md", "b.md", "related"), ("a.md", "old.md", "related"), ("b.md", "far.md", "related"), ("gone.md", "a.md", "related"), ("b.md", "a.md", "related")], "from_path string, to_path string, link_type string")
    none = spark.createDataFrame([], "source_id string, target_id string, relation string, weight double, created_at long")
    got = bd.graph_from_pages(nodes, none, pages, links, 7)
    new = {n.content: n for n in got["nodes"].collect()}
    assert set(new) == {"b.md", "c.md"} and {n.confidence for n in new.values()} == {0.5} and {n.node_type for n in new.values()} == {"wiki_page"}
    b = new["b.md"].node_id
    assert {(e.source_id, e.target_id, e.weight) for e in got["edges"].collect()} == {("n1", b, 0.6), ("n1", "n9", 0.6), (b, "n1", 0.6)}
    old = spark.createDataFrame([("n1", b, "related", 0.9, 1)], none.schema)
    assert got["edges"].count() - bd.graph_from_pages(nodes, old, pages, links, 7)["edges"].count() == 1


def test_causes_take_the_first_confidence_and_the_last_weight(spark):
    nodes = spark.createDataFrame([("n1", "user", "u", "action", "deploy")], NODES)
    rows = [("user", "u", "deploy", "crash", "caused", 0.4, 1), ("user", "u", "deploy", "crash", "caused", 0.9, 2), ("user", "u", "test", "crash", "prevented", 0.7, 3), ("user", "u", "x", "y", "likes", 0.7, 3), ("user", "u", "x", "y", None, 0.7, 3)]
    got = bd.causes(nodes, spark.createDataFrame(rows, "layer string, user_id string, action string, outcome string, relation string, strength double, at long"))
    assert {(n.content, n.node_type, n.confidence) for n in got["nodes"].collect()} == {("crash", "outcome", 0.4), ("test", "action", 0.7)}
    assert sorted((e.relation, e.weight) for e in got["edges"].collect()) == [("caused", 0.9), ("prevented", 0.7)]
    assert "n1" in {e.source_id for e in got["edges"].collect()} and got["rejected"].count() == 2


@pytest.mark.parametrize("word", ["I", "The", "Это"])
def test_words_that_are_no_names_say_nothing(spark, word):
    row = spark.createDataFrame([(f"{word} knows Bob",)], "t string").select(bd.relations(F.col("t")).alias("r")).first()
    assert row.r == []
