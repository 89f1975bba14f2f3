"""Many patterns in many texts: substrings by one automaton in one pass, and the rules, hints and feelings built on it.

Patterns are a table. They are dealt into groups of at most GROUP_CHARS characters by hash; of each group one Aho-Corasick
automaton is built in each worker that reads texts, and texts pass it in Arrow batches, so work follows the texts'
length and not texts x patterns. What is shuffled are narrow rows of hits."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of patterns that one automaton holds (about); one pass over the texts for each such group.
GROUP_CHARS = 4_000_000

# Words that point to a route, in the routes' order; routes told at most.
ROUTES = [
    ("recover context in a new session", "новая сессия|с чего начали|what were we|recap|continuit|resume"),
    ("recall what was said or decided earlier", "найди|вспомни|что говорил|обсуждали|what did|where did|recall|earlier|discussed"),
    ("keep a working note across compaction", "гипотез|черновик|запиши пока|hypothesis|working note|for now"),
    ("store a durable fact or decision", "запомни|помни|навсегда|remember|durable|important fact"),
    ("procedural / skill knowledge", "how do i|how to|procedure|skill|инструкция|как делать|шаги"),
    ("rate whether recalled memory helped", "помогло|было полезно|was useful|feedback|useful signal"),
    ("review staged memory mutations", "proposal|staged|на согласовании|pending review"),
    ("memory health / stats overview", "статистик|сколько записей|how many|health|report card|stats"),
]
MOST_HINTS = 3

# Words, phrases and signs of feelings with what they count.
FEELING_WORDS = {
    "love": ["люблю", "обожаю", "love", "adore", "dear", "любимая", "любимый"],
    "joy": ["рад", "радость", "счастлив", "happy", "joy", "great", "отлично", "прекрасно"],
    "gratitude": ["спасибо", "благодарю", "thanks", "thank you", "grateful"],
    "anger": ["злюсь", "бесит", "angry", "furious", "ненавижу"],
    "sadness": ["грустно", "печаль", "sad", "unfortunately", "сожалению"],
    "fear": ["боюсь", "страшно", "afraid", "scared", "worried"],
    "surprise": ["удивлён", "wow", "wow!", "ничего себе", "unexpectedly"],
    "interest": ["интересно", "curious", "fascinating", "заинтригован"],
}
FEELING_PHRASES = [
    ("я тебя люблю", "love", 0.8),
    ("ты дорог мне", "love", 0.8),
    ("ты лучшая", "love", 0.7),
    ("скучаю по тебе", "love", 0.8),
    ("i love you", "love", 0.8),
    ("my dear", "love", 0.7),
    ("i miss you", "love", 0.8),
    ("you mean a lot to me", "love", 0.7),
    ("мне грустно", "sadness", 0.6),
    ("i am sad", "sadness", 0.6),
    ("я счастлив", "joy", 0.7),
    ("спасибо большое", "gratitude", 0.6),
]
FEELING_SIGNS = {
    "love": ["❤️", "💕", "😘", "🥰"],
    "joy": ["😄", "🎉", "😊", "🙌"],
    "gratitude": ["🙏", "💐"],
    "anger": ["😠", "😡", "🤬"],
    "sadness": ["😢", "😞", "😭"],
    "fear": ["😨", "😰"],
    "surprise": ["😲", "😮", "😱"],
}
WORD_SCORE, SIGN_SCORE = 0.4, 0.3


def occurrences(texts: DataFrame, ident: Sequence[str], text: str, patterns: DataFrame, pattern: str = "pattern", group_chars: int = GROUP_CHARS) -> DataFrame:
    """One row for each text and pattern in it: the columns ident, pattern, n (occurrences, overlapping ones too) and first (place from 0).

    Letters must match as they are: lower-case both sides where case is not to matter. Null and empty patterns match
    nothing, null texts hold nothing; texts that repeat give rows each."""
    wanted = patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    chars = wanted.agg(F.sum(F.length("pattern"))).first()[0] or 0
    groups = max(1, math.ceil(chars / group_chars))
    narrow = texts.select(*ident, F.col(text).alias("_text"))
    schema = narrow.drop("_text").schema.add("pattern", "string").add("n", "long").add("first", "long")
    out = None
    for g in range(groups):
        some = wanted if groups == 1 else wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(groups)) == g)
        # A group's size is bounded, so its words may pass through the driver.
        found = narrow.mapInArrow(_finder([r.pattern for r in some.collect()], list(ident)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(words: list[str], ident: list[str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not words:
            return
        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(w, w)
        machine.make_automaton()
        for batch in batches:
            rows, found, counts, firsts = [], [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                hits: dict[str, list[int]] = {}
                for end, w in machine.iter(text or ""):
                    hits.setdefault(w, [0, end - len(w) + 1])[0] += 1
                rows += [i] * len(hits)
                found += hits
                counts += [h[0] for h in hits.values()]
                firsts += [h[1] for h in hits.values()]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ident), pa.array(found, pa.string()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64())], [*ident, "pattern", "n", "first"])

    return find


def disclosures(messages: DataFrame, rules: DataFrame, ident: str, text: str = "text", user: str = "user_id", most: int = 3, newest: int = 100) -> DataFrame:
    """messages (ident, user, text), rules (rule_id, user, name, keywords, enabled): ident, rule_id, name and place of the rules that a message tells of.

    A rule counts if any of its keywords is part of the text, in any case. Of a user's enabled rules the `newest` count,
    and of those that match the `most` with the highest ids."""
    w = Window.partitionBy(user).orderBy(F.desc("rule_id"))
    live = rules.where("enabled").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= newest)
    keys = live.select(user, "rule_id", "name", F.explode("keywords").alias("keyword")).select(user, "rule_id", "name", F.lower("keyword").alias("pattern")).distinct()
    found = occurrences(messages.select(ident, user, F.lower(text).alias("_low")), [ident, user], "_low", keys)
    told = found.select(ident, user, "pattern").join(keys, [user, "pattern"]).select(ident, "rule_id", "name").distinct()
    place = F.row_number().over(Window.partitionBy(ident).orderBy(F.desc("rule_id")))
    return told.withColumn("place", place).where(F.col("place") <= most)


def steering_hints(queries: DataFrame, ident: str, text: str = "query", routes: Sequence[tuple[str, str]] = ROUTES, most: int = MOST_HINTS) -> DataFrame:
    """ident, route (its name) and place of the first `most` routes with a word in the query; a blank query gets all routes."""
    spark = queries.sparkSession
    table = spark.createDataFrame([(i, name, w) for i, (name, ws) in enumerate(routes) for w in ws.split("|")], "at int, route string, pattern string")
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    found = occurrences(queries.where(~blank).select(ident, F.lower(text).alias("_low")), [ident], "_low", table)
    hit = found.join(F.broadcast(table), "pattern").select(ident, "at", "route").distinct()
    first = hit.withColumn("place", F.row_number().over(Window.partitionBy(ident).orderBy("at"))).where(F.col("place") <= most).select(ident, "route", "place")
    every = F.inline(F.array(*[F.struct(F.lit(name).alias("route"), F.lit(i + 1).alias("place")) for i, (name, _) in enumerate(routes)]))
    return first.unionByName(queries.where(blank).select(ident, every))


def _gap(phrase: str) -> str:
    """A phrase whose words may have one more word between."""
    return "\\s+(?:\\w+\\s+)?".join(phrase.split(" "))


def feelings(text: Column) -> Column:
    """Array of (feeling, score, source) of a text, by feeling: the best of its phrases, words (0.4) and signs (0.3); empty for none.

    Phrases are read from the left, each match from behind the last, the earlier of the list first; so are words."""
    t = F.coalesce(text, F.lit(""))
    every = lambda body: F.regexp_extract_all(t, F.lit(f"(?iuU)(?:{body})"), 0)
    phrase_of = lambda hit: F.coalesce(*[F.when(hit.rlike(f"(?iuU)^{_gap(p)}$"), F.struct(F.lit(e).alias("feeling"), F.lit(s).alias("score"), F.lit("phrase").alias("source"))) for p, e, s in FEELING_PHRASES])
    phrases = F.transform(every("|".join(_gap(p) for p, *_ in FEELING_PHRASES)), phrase_of)
    pick = lambda table, score, source: lambda hit: F.struct(F.element_at(F.create_map(*[F.lit(x) for e, ws in table.items() for w in ws for x in (w, e)]), F.lower(hit)).alias("feeling"), F.lit(score).alias("score"), F.lit(source).alias("source"))
    quoted = lambda ws: "|".join(f"\\Q{w}\\E" for w in ws)
    words = F.transform(every("|".join(f"\\b(?:{quoted(ws)})\\b" for ws in FEELING_WORDS.values())), pick(FEELING_WORDS, WORD_SCORE, "word"))
    signs = F.transform(every("|".join(quoted(ws) for ws in FEELING_SIGNS.values())), pick(FEELING_SIGNS, SIGN_SCORE, "sign"))
    found = F.concat(phrases, words, signs)
    names = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["feeling"])))
    # The first of the best: phrases come before words, words before signs.
    best = lambda name: F.aggregate(F.filter(found, lambda x: x["feeling"] == name), F.lit(None).cast("struct<feeling: string, score: double, source: string>"), lambda a, x: F.when(a.isNull() | (x["score"] > a["score"]), x).otherwise(a))
    return F.transform(names, best)


def save_trigger(text: Column) -> Column:
    """(trigger, score): why a message is worth keeping, the first of the highest score; null if nothing speaks for it.

    Feelings, length over 300 (0.3), three question marks (0.4); two exclamation marks (0.3) only beside another reason."""
    t = F.coalesce(text, F.lit(""))
    of = lambda name, score: F.struct(F.lit(name).alias("trigger"), F.lit(score).alias("score"))
    marks = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    felt = F.transform(feelings(text), lambda x: F.struct(F.concat(F.lit("emotion_"), x["feeling"]).alias("trigger"), x["score"].alias("score")))
    shape = F.array_compact(F.array(F.when(F.length(t) > 300, of("long_message", 0.3)), F.when(marks("?") >= 3, of("complex_question", 0.4))))
    base = F.concat(felt, shape)
    loud = F.when((F.size(base) > 0) & (marks("!") >= 2), F.array(of("exclamation", 0.3))).otherwise(F.array().cast("array<struct<trigger: string, score: double>>"))
    return F.aggregate(F.concat(base, loud), F.lit(None).cast("struct<trigger: string, score: double>"), lambda a, x: F.when(a.isNull() | (x["score"] > a["score"]), x).otherwise(a))
