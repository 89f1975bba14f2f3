"""What a question looks like, and which sources it is worth asking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# Words and marks that features look for.
ASKING = ["почему", "как", "зачем", "why", "how"]
ORDERS = ["сделай", "найди", "покажи", "расскажи", "напиши", "исправь", "добавь", "удали", "проверь", "show", "find", "list", "fix", "add", "remove", "write", "check", "run"]
NEGATIONS = ["не", "нет", "no", "not", "never"]
CODE_MARKS = ["```", "def ", "import ", "Traceback", "npm ", "git ", "SELECT ", ".py", ".json", ".yaml", ".ts", "()", "[]"]
TIMES = ["сегодня", "вчера", "завтра", "неделю назад", "месяц назад", "прошлый", "последний", "today", "yesterday", "recently", "last week"]
DEADLINES = ["дедлайн", "deadline", "к концу", "к пятнице", "к понедельнику", "до конца", "by friday", "by monday", "eod"]
LIGHT_WORDS = ["и", "в", "не", "на", "что", "с", "а", "по", "как", "это", "для", "из", "у", "же", "the", "a", "an", "of", "to", "in", "is", "and", "or", "it"]
COMPARISONS = [" vs ", " или ", " сравн", "compare", "versus"]
GOING_ON, GOING_ON_WORDS = ["а ", "и ", "но "], ["тоже", "also"]
GREETINGS = ["привет", "здравствуй", "доброе утро", "hi", "hello", "hey"]
WIKI_MARKS = ["документаци", "справк", "официальн", "что такое", "как работает", "docs", "documentation"]
EPISODE_MARKS = ["помнишь", "напомни", "в прошлый раз", "мы уже", "где мы", "did we", "remember when", "перестал работать"]
WORD, ANY_CASE_WORD = "[а-яёa-z0-9]+", "[A-Za-zА-Яа-яЁё0-9]+"
DATE, YEAR = "[0-9]{1,2}[./-][0-9]{1,2}", "(?U)\\b(19|20)[0-9]{2}\\b"
SHORT, LONG, LEAST = 4, 12, 3

SOURCES = ("rag", "wiki", "episodic", "core", "graph")


def query_features(query: Column, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """27 features of a question as one struct; null is an empty question. Ratios are rounded half to even.

    Words are those of two alphabets and digits; the words of features have three letters at least, so shorter negations never count."""
    q = F.regexp_replace(F.coalesce(query, F.lit("")), "(?U)^\\s+|\\s+$", "")
    low = F.lower(q)
    words = F.regexp_extract_all(low, F.lit(WORD), 0)
    some = F.array_distinct(F.filter(words, lambda w: F.length(w) >= LEAST))
    listed = lambda ws: F.array(*map(F.lit, ws))
    meets = lambda ws: F.arrays_overlap(some, listed(ws)) if ws else F.lit(False)
    has = lambda marks, t=low: reduce(or_, [F.contains(t, F.lit(m)) for m in marks])
    opens = lambda marks: reduce(or_, [F.startswith(low, F.lit(m)) for m in marks])
    part = lambda x: F.when(F.size(words) > 0, x / F.size(words)).otherwise(0.0)
    n = F.size(F.filter(F.split(q, "(?U)\\s+"), lambda w: w != ""))
    later = F.regexp_extract_all(q, F.lit(ANY_CASE_WORD), 0)
    known = sorted(set(synonyms) | {v for vs in synonyms.values() for v in vs})
    found = {
        "length": n, "chars": F.length(q), "is_short": n <= SHORT, "is_long": n >= LONG,
        "is_question": F.endswith(low, F.lit("?")) | meets(ASKING), "has_question_mark": has(["?"]), "is_imperative": F.coalesce(F.get(words, 0).isin(ORDERS), F.lit(False)), "is_negated": meets(NEGATIONS),
        "has_entity": meets(known), "n_capitalized": F.size(F.filter(later, lambda w, i: (i > 0) & w.rlike("^[A-ZА-ЯЁ]"))), "has_numbers": q.rlike("(?U)\\d"), "has_code": has(CODE_MARKS, q),
        "has_date": q.rlike(DATE), "has_year": q.rlike(YEAR), "has_relative_time": has(TIMES), "has_deadline": has(DEADLINES),
        "unique_ratio": F.bround(part(F.size(some)), 3), "stopword_ratio": F.bround(part(F.size(F.filter(words, lambda w: w.isin(LIGHT_WORDS)))), 3), "avg_word_len": F.bround(part(F.length(F.array_join(words, ""))), 2),
        "is_enumerative": low.rlike(f"(?U)({'|'.join(tx.ENUMERATIVE)})"), "is_comparison": has(COMPARISONS), "is_followup": opens(GOING_ON) | meets(GOING_ON_WORDS) | has(["what about"]), "is_greeting": opens(GREETINGS),
        "has_url": has(["http", "www."]), "has_quote": has(['"', "«"], q), "wants_wiki": has(WIKI_MARKS), "wants_episodic": has(EPISODE_MARKS),
    }
    return F.struct(*[c.alias(name) for name, c in found.items()])


def gate_sources(features: Column) -> Column:
    """Struct of booleans, by source, of whether a question with these features is to be asked of it; the first rule that holds decides."""
    of = lambda *asked: F.struct(*[F.lit(s in asked).alias(s) for s in SOURCES])
    f = lambda name: features[name]
    return (
        F.when(f("is_enumerative"), of("wiki", "core", "graph"))
        .when(f("is_short") & ~f("is_question"), of("rag", "core"))
        .when(f("has_entity"), of("rag", "wiki", "core", "graph"))
        .when(f("has_code") | f("has_url"), of("rag", "wiki", "core"))
        .when(f("wants_episodic") | f("has_relative_time") & f("is_question"), of("rag", "episodic", "core"))
        .otherwise(of(*SOURCES))
    )
