"""Building the graph: relations and people found in texts by patterns, nodes found or added, pages with their links, causes.

A new node's id is made from its names, so a run that is repeated finds what the one before it added. Texts are read
once and what is said often is made distinct before any join; node tables are only shuffled if what is looked up in them is large."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

# A name, what stands between two of them for each relation (with the type of the second), what comes before a
# person's name, and capitalised words that are no names. Case counts in the last alone.
NAME = r"[A-ZА-ЯЁ][\wа-яё-]{1,29}"
RELATIONS = [
    (r"\s+(?:works\s+(?:at|for)|работает\s+(?:в|на))\s+", "works_with", "organization"),
    (r"\s+(?:knows|знает)\s+", "knows", "person"),
    (r"\s+(?:is\s+friends\s+with|дружит\s+с)\s+", "friend_of", "person"),
    (r"\s+(?:is\s+part\s+of|входит\s+в|часть)\s+", "member_of", "organization"),
    (r"\s+(?:met|встретил\s+|встретила\s+)", "met", "person"),
]
MEETING = r"(?:встретил|встретилась|встретил(?:а|и)\s+с|поговорил(?:а)?\s+с|позвонил(?:а)?\s+|написал(?:а)?\s+|met|talked\s+to|called)\s+(?:с\s+)?"
NO_NAMES = ["I", "The", "A", "An", "This", "That", "We", "It", "В", "На", "Мы", "Он", "Она", "Они", "Это", "Сегодня"]
CAUSES = ("caused", "led_to", "prevented")

ENTITY_CONFIDENCE, RELATION_WEIGHT, LINK_WEIGHT = 0.5, 0.8, 0.6
IDENTITY = ("layer", "user_id", "node_type", "content")
_FLAGS = "(?iuU)"


def _is_name(word: Column) -> Column:
    return (F.length(word) >= 2) & ~word.isin(NO_NAMES)


def relations(text: Column) -> Column:
    """Array of (subject, relation, object, object_type) said in a text, by relation and place; those that repeat stay. Null: none.

    Matches of one relation don't overlap, so "A knows B knows C" says only that A knows B."""
    t = F.coalesce(text, F.lit(""))

    def of(between: str, relation: str, kind: str) -> Column:
        body = f"{_FLAGS}({NAME}){between}({NAME})"
        # A match cut out of its text matches again with the same groups: nothing in the pattern looks beyond it.
        part = lambda hit, k: F.regexp_extract(hit, body, k)
        hits = F.transform(F.regexp_extract_all(t, F.lit(body), 0), lambda hit: F.struct(part(hit, 1).alias("subject"), F.lit(relation).alias("relation"), part(hit, 2).alias("object"), F.lit(kind).alias("object_type")))
        return F.filter(hits, lambda x: _is_name(x["subject"]) & _is_name(x["object"]))

    return F.concat(*[of(*r) for r in RELATIONS])


def people(text: Column) -> Column:
    """Array of the names of people that a text's writer met, called, wrote or talked to, by place. Null: none."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{_FLAGS}{MEETING}({NAME})"), 1)
    return F.filter(hits, _is_name)


def find_or_add(nodes: DataFrame, wanted: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """wanted (layer, user_id, node_type, content, confidence, at), one row for each identity, with node_id and created.

    An equal node's smallest id is taken, else one is made from the identity. The first wanted row gives what isn't part
    of the identity (at one time: by type and confidence). Nulls are equal to each other; rows without content are left out."""
    rest = [c for c in ("node_type", "confidence", "at") if c not in identity]
    first = F.min(F.struct("at", *[c for c in rest if c != "at"]))
    one = wanted.where("content is not null").groupBy(*identity).agg(first.alias("_f")).select(*identity, *[F.col(f"_f.{c}").alias(c) for c in rest])
    same = lambda a, b: reduce(and_, [a[c].eqNullSafe(b[c]) for c in identity])
    have = nodes.select(*identity, "node_id")
    met = have.join(one.select(*identity), same(have, one), "left_semi").groupBy(*identity).agg(F.min("node_id").cast("string").alias("_id"))
    made = F.concat(F.lit("e"), F.substring(F.sha2(F.to_json(F.struct(*[one[c] for c in identity])), 256), 1, 32))
    out = one.join(met, same(one, met), "left")
    return out.select(*[one[c] for c in (*identity, *rest)], F.coalesce("_id", made).alias("node_id"), F.col("_id").isNull().alias("created"))


def replaced(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with new ones in place of those with the same source, target and relation."""
    return edges.join(new, ["source_id", "target_id", "relation"], "left_anti").unionByName(new)


def _ends(edges: DataFrame, ids: DataFrame, end: str, **names: str) -> DataFrame:
    """edges with the id of the node that the columns in names give as `end`; edges without one are left out."""
    side = ids.select(*[F.col(c).alias(f"_{c}") for c in names], F.col("node_id").alias(end))
    return edges.join(side, reduce(and_, [edges[v].eqNullSafe(side[f"_{c}"]) for c, v in names.items()])).drop(*[f"_{c}" for c in names])


def _added(ids: DataFrame) -> DataFrame:
    return ids.where("created").select("node_id", *IDENTITY, "confidence", F.col("at").alias("created_at"))


def graph_from_texts(nodes: DataFrame, texts: DataFrame, now: int, hours: int = 24) -> dict[str, DataFrame]:
    """nodes (node_id, layer, user_id, node_type, content), texts (layer, user_id, text, created_at) of the last `hours`.

    Returns nodes (those to add) and edges (0.8 each; they take the place of equal ones, see replaced), each once however often it is said."""
    recent = texts.where(F.col("created_at") > now - hours * 3600)
    lone = F.transform(people(F.col("text")), lambda x: F.struct(x.alias("subject"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("object"), F.lit(None).cast("string").alias("object_type")))
    said = cut(recent.select("layer", "user_id", F.inline(F.concat(relations(F.col("text")), lone))).distinct())
    of = lambda name, kind: said.select("layer", "user_id", kind.alias("node_type"), F.col(name).alias("content"), F.lit(ENTITY_CONFIDENCE).alias("confidence"), F.lit(now).alias("at"))
    ids = cut(find_or_add(nodes, of("subject", F.lit("person")).unionByName(of("object", F.col("object_type")))))
    links = said.where("relation is not null").withColumn("subject_type", F.lit("person"))
    scope = {"layer": "layer", "user_id": "user_id"}
    met = _ends(_ends(links, ids, "source_id", **scope, node_type="subject_type", content="subject"), ids, "target_id", **scope, node_type="object_type", content="object")
    # A relation fixes its types, and names of one type have ids of their own: edges are distinct as they are.
    edges = met.select("source_id", "target_id", "relation", F.lit(RELATION_WEIGHT).alias("weight"), F.lit(now).alias("created_at"))
    return {"nodes": _added(ids), "edges": edges}


def graph_from_pages(nodes: DataFrame, edges: DataFrame, pages: DataFrame, links: DataFrame, now: int) -> dict[str, DataFrame]:
    """pages (layer, user_id, path, importance), links (from_path, to_path, link_type): a node for each page, whose path is its content,
    and an edge of 0.6 for each link out of a page to a page or to a path that has a node already. Edges that exist stay as they are.

    Pages without importance (or with 0) count 0.5. A path's node may be of any type; new ones are wiki_page."""
    scope = ["layer", "user_id", "content"]
    wanted = pages.select("layer", "user_id", F.lit("wiki_page").alias("node_type"), F.col("path").alias("content"), F.when(F.col("importance") != 0, F.col("importance")).otherwise(F.lit(0.5)).alias("confidence"), F.lit(now).alias("at"))
    ids = cut(find_or_add(nodes, wanted, scope))
    out = ids.select(F.col("content").alias("from_path"), "layer", "user_id", F.col("node_id").alias("source_id")).join(links.distinct(), "from_path")
    named = out.select("layer", "user_id", F.col("to_path").alias("content")).distinct()
    older = nodes.join(named, scope, "left_semi").groupBy(*scope).agg(F.min("node_id").cast("string").alias("node_id"))
    every = ids.select(*scope, "node_id").unionByName(older.join(ids, scope, "left_anti"))
    met = _ends(out, every, "target_id", layer="layer", user_id="user_id", content="to_path")
    new = met.select("source_id", "target_id", F.col("link_type").alias("relation"), F.lit(LINK_WEIGHT).alias("weight"), F.lit(now).alias("created_at")).distinct()
    return {"nodes": _added(ids), "edges": new.join(edges, ["source_id", "target_id", "relation"], "left_anti")}


def causes(nodes: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """pairs (layer, user_id, action, outcome, relation, strength, at): action and outcome nodes to add and the edges between them.

    A node's confidence is the strength of the first pair that names it, an edge's weight that of the last (at one time the larger).
    Pairs whose relation is none of caused, led_to and prevented come back as rejected and have no effect."""
    known = F.coalesce(F.col("relation").isin(*CAUSES), F.lit(False))
    good = pairs.where(known)
    of = lambda name: good.select("layer", "user_id", F.lit(name).alias("node_type"), F.col(name).alias("content"), F.col("strength").alias("confidence"), "at")
    ids = cut(find_or_add(nodes, of("action").unionByName(of("outcome"))))
    last = good.groupBy("layer", "user_id", "action", "outcome", "relation").agg(F.max(F.struct("at", "strength")).alias("_l"))
    last = last.select("*", "_l.*", F.lit("action").alias("_action"), F.lit("outcome").alias("_outcome")).drop("_l")
    scope = {"layer": "layer", "user_id": "user_id"}
    met = _ends(_ends(last, ids, "source_id", **scope, node_type="_action", content="action"), ids, "target_id", **scope, node_type="_outcome", content="outcome")
    return {"nodes": _added(ids), "edges": met.select("source_id", "target_id", "relation", F.col("strength").alias("weight"), F.col("at").alias("created_at")), "rejected": pairs.where(~known)}
