"""Files as tables: chat exports, journals in JSON lines, Markdown with a head, HTML to Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def _seconds(c: Column) -> Column:
    """Epoch seconds of a number or an ISO time, null where it is neither."""
    return F.coalesce(c.try_cast("double"), F.unix_micros(F.try_to_timestamp(c)) / 1e6)


def _text(content: Column) -> Column:
    """Content that is a text, or a JSON list of texts and of objects with a text."""
    parts = F.from_json(content, "array<string>")
    each = F.transform(parts, lambda p: F.when(p.startswith("{"), F.coalesce(F.get_json_object(p, "$.text"), F.get_json_object(p, "$.content"), F.lit(""))).otherwise(p))
    joined = F.array_join(F.filter(each, lambda p: p != ""), " ")
    return F.coalesce(F.when(content.startswith("["), joined), content, F.lit(""))


def claude(spark: SparkSession, path: str) -> DataFrame:
    """role, text, ts of each message of an export: a list of conversations with messages."""
    rows = spark.read.schema("messages array<struct<role: string, content: string, created_at: string>>").json(path, multiLine=True)
    m = rows.select(F.explode("messages").alias("m"))
    return m.select("m.role", _text(F.col("m.content")).alias("text"), _seconds(F.col("m.created_at")).alias("ts"))


def chatgpt(spark: SparkSession, path: str) -> DataFrame:
    """role, text, ts of each message of an export: a list of conversations with a mapping of nodes. System and tool messages go."""
    message = "struct<author: struct<role: string>, content: struct<parts: string>, create_time: string>"
    rows = spark.read.schema(f"mapping map<string, struct<message: {message}>>").json(path, multiLine=True)
    m = rows.select(F.explode(F.map_values("mapping")).alias("n")).select("n.message.*").where("author is not null or content is not null")
    kept = m.where(F.coalesce(~F.col("author.role").isin("system", "tool"), F.lit(True)))
    return kept.select("author.role", F.trim(_text(F.col("content.parts"))).alias("text"), _seconds(F.col("create_time")).alias("ts"))


def memory_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of key, value, ts."""
    rows = spark.read.schema("key string, value string, ts string").json(path, multiLine=True)
    return rows.select(F.lit(None).cast("string").alias("role"), F.concat(F.coalesce("key", F.lit("None")), F.lit(": "), F.coalesce("value", F.lit("None"))).alias("text"), _seconds(F.col("ts")).alias("ts"))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A record for each line, its text in text, message or content."""
    rows = spark.read.schema("role string, text string, message string, content string, ts string").json(path)
    some = [F.when(F.col(c) != "", F.col(c)) for c in ("text", "message", "content")]
    return rows.select("role", F.coalesce(*some, F.lit("")).alias("text"), _seconds(F.col("ts")).alias("ts"))


FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"claude": claude, "chatgpt": chatgpt, "memory-json": memory_json, "jsonl": jsonl}


def records(spark: SparkSession, kind: str, path: str) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}: one of {', '.join(sorted(FORMATS))}")
    return FORMATS[kind](spark, path)


def parsed_markdown(df: DataFrame, text: str = "value", path: str = "path") -> DataFrame:
    """path and what a Markdown text with a head (between two lines of ---) says: title, wiki_type, tags, importance, status, content.

    Without a head all is content; the title is then the file's name, the type note, the importance 0.5 and the
    status active, as it is for a status that isn't active, stale or archived. Heads hold simple keys and lists."""
    head = F.regexp_extract(text, "(?s)^---[ \\t]*\\n(.*?)\\n---[ \\t]*(?:\\n|$)", 1)
    body = F.regexp_replace(text, "(?s)^---[ \\t]*\\n.*?\\n---[ \\t]*(?:\\n|$)", "")
    flat = F.regexp_replace(F.regexp_replace(head, "\\n[ \\t]*- +", ", "), "(?m)^([A-Za-z_]+):[ \\t]*", "$1\u0001")
    pairs = F.transform(F.filter(F.split(flat, "\n"), lambda x: x.contains("\u0001")), lambda x: F.struct(F.substring_index(x, "\u0001", 1).alias("k"), F.trim(F.substring_index(x, "\u0001", -1)).alias("v")))
    d = df.select(F.col(path).alias("path"), F.trim(F.regexp_replace(body, "^\\s+|\\s+$", "")).alias("content"), F.map_from_entries(F.filter(pairs, lambda p: p["v"] != "")).alias("m"))
    got = lambda k: F.regexp_replace(F.element_at("m", k), "^[\"']|[\"']$", "")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), "\\.[^.]*$", "")
    tags = F.filter(F.transform(F.split(F.regexp_replace(F.element_at("m", "tags"), "^\\[|\\]$|^, ", ""), ","), lambda t: F.regexp_replace(F.trim(t), "^[\"']|[\"']$", "")), lambda t: t != "")
    status = F.lower(F.trim(got("status")))
    return d.select(
        "path",
        F.coalesce(got("title"), F.when(stem != "", stem), F.lit("Untitled")).alias("title"),
        F.coalesce(got("wiki_type"), F.lit("note")).alias("wiki_type"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        F.coalesce(got("importance").try_cast("double"), F.lit(0.5)).alias("importance"),
        F.when(status.isin("stale", "archived"), status).otherwise("active").alias("status"),
        "content",
    )


def to_markdown(df: DataFrame) -> Column:
    """The text of a row of parsed_markdown(); parsing it again gives the row."""
    lines = [F.concat(F.lit(f"{k}: "), df[k].cast("string")) for k in ("title", "wiki_type", "importance", "status")]
    return F.concat_ws("\n", F.lit("---"), *lines, F.concat(F.lit("tags: ["), F.array_join(df["tags"], ", "), F.lit("]")), F.lit("---"), df["content"])


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file below path."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    return parsed_markdown(rows)


# What each step of html_to_markdown replaces, in this order (both engines read these patterns alike).
HTML_STEPS = [
    ("(?s)<(script|style)[^>]*>.*?</(script|style)>", ""),
    ("(?s)<!--.*?-->", ""),
    ("<h1[^>]*>", "\n# "),
    ("<h2[^>]*>", "\n## "),
    ("<h3[^>]*>", "\n### "),
    ("<li[^>]*>", "\n- "),
    ("<br[^>]*>", "\n"),
    ("</?(p|div|ul|ol|table|tr|nav|h1|h2|h3|section|article|header|footer)(\\s[^>]*)?>", "\n"),
    ("(?s)<[^>]*>", ""),
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("[ \\t]+\n", "\n"),
    ("\n{3,}", "\n\n"),
]


def html_to_markdown(html: Column) -> Column:
    out = F.coalesce(html, F.lit(""))
    for pattern, by in HTML_STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(by))
    return F.regexp_replace(out, "^\\s+|\\s+$", "")
