"""Text functions as column expressions: token sets, chunking, previews, budgets, similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: letters and digits of any script.
WORD = "([\\pL\\pN]+)"

# Words that carry no content.
STOP_WORDS = ["and", "are", "but", "for", "from", "has", "have", "not", "that", "the", "this", "was", "were", "will", "with", "you"]


def tokens(text: Column, least: int = 3) -> Column:
    """Distinct lower-case words of letters and digits, `least` characters or more; null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1)
    return F.array_distinct(F.filter(found, lambda x: F.length(x) >= least))


def content_tokens(text: Column) -> Column:
    return F.array_except(tokens(text), F.array(*[F.lit(w) for w in STOP_WORDS]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ > 0, both / all_).otherwise(0.0)


def char_ngrams(text: Column, n: int = 3) -> Column:
    t = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n))))


def estimate_tokens(text: Column) -> Column:
    """Characters of East Asian scripts count one each, all others a quarter."""
    wide = F.length(F.regexp_replace(text, "[^\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7af]", ""))
    return (wide + F.floor((F.length(text) - wide) / 4)).cast("long")


def preview(text: Column, sentences: int = 2, most: int = 400) -> Column:
    """The first sentences, cut to `most` characters."""
    parts = F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(s) != "")
    return F.substring(F.array_join(F.transform(F.slice(parts, 1, sentences), lambda s: F.trim(s)), ". "), 1, most)


def within_budget(text: Column, most_tokens: int) -> Column:
    """Whole lines from the start while their estimate stays within most_tokens."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))

    def step(acc, line):
        n = acc["n"] + estimate_tokens(line)
        fits = acc["open"] & (n <= most_tokens)
        return F.struct(F.when(fits, n).otherwise(acc["n"]).alias("n"), F.when(fits, F.array_append(acc["kept"], line)).otherwise(acc["kept"]).alias("kept"), fits.alias("open"))

    return F.array_join(F.aggregate(F.split(text, "\n"), start, step)["kept"], "\n")


def atoms(text: Column, most: int = 10, least: int = 15) -> Column:
    """Sentences or lines of at least `least` characters, `most` at most."""
    parts = F.transform(F.split(text, "(?<=[.!?])\\s+|\\n+"), lambda s: F.trim(s))
    return F.slice(F.filter(parts, lambda s: F.length(s) >= least), 1, most)


# Marks of queries that ask for all of a kind, and of queries that ask for causes.
ENUMERATIVE = ["\\bвсе(х|м|е|ё)?\\b", "\\bсписок\\b", "перечисл", "list\\s+all", "\\benumerate\\b"]
CAUSES = ["почему", "из-за", "привело", "влияет", "цепочк", "поэтому", "следств"]


def classify_query(query: Column) -> Column:
    """enumerative (asks for all of a kind), multi_hop (asks for causes, or has ten words or more) or factual; null is factual."""
    q = F.trim(F.lower(F.coalesce(query, F.lit(""))))
    enumerative = q.rlike(f"(?U)({'|'.join(ENUMERATIVE)})")
    causal = q.rlike("|".join(CAUSES)) | (F.size(F.split(q, "\\s+")) >= 10)
    return F.when(enumerative, "enumerative").when(causal, "multi_hop").otherwise("factual")


# Words that make a message look worth keeping.
KEYWORDS = [
    "решил", "помни", "важно", "изменил", "запомни", "создал", "написал", "починил", "сломал", "понял", "надо", "нужно", "хочу", "буду",
    "сделал", "архитектура", "дизайн", "план", "решение", "баг", "ошибка", "фикс", "патч", "релиз", "люблю", "ненавижу", "обожаю", "бесит",
    "important", "critical", "bug", "fix", "release", "decision", "error",
]


def structure_score(text: Column) -> Column:
    """How much a message looks worth keeping, from its shape alone, in 0..1."""
    t = F.coalesce(text, F.lit(""))
    question, keyword = t.contains("?"), F.lower(t).rlike("|".join(KEYWORDS))
    parts = [(F.length(t) > 100, 0.2), (question, 0.15), (t.contains("!"), 0.1), (keyword, 0.2), (F.size(F.split(t, "\n")) >= 3, 0.15), (question & keyword, 0.1)]
    total = sum((F.when(c, v).otherwise(0.0) for c, v in parts), F.lit(0.0))
    return F.when(F.length(t) < 20, 0.0).otherwise(F.least(F.lit(1.0), total))


def chunks(most: int = 500, overlap: int = 100):
    """An array function: paragraphs packed into chunks of at most `most` characters.

    A full chunk's last `overlap` characters open the next; a paragraph that is too long is cut between
    words, each piece opening with the last words of the one before. Null and blank texts give no chunk."""
    if overlap >= most:
        raise ValueError("overlap must be smaller than the chunk")

    def long_paragraph(paragraph: str) -> list[str]:
        out, piece, size = [], [], 0
        for word in paragraph.split():
            if piece and size + len(word) > most:
                out.append(" ".join(piece))
                piece = piece[-max(1, overlap // 8) :] if overlap else []
                size = sum(map(len, piece)) + len(piece)
            piece.append(word)
            size += len(word) + 1
        return [*out, " ".join(piece)]

    def split(text: str | None) -> list[str]:
        out: list[str] = []
        open_: list[str] = []
        for paragraph in filter(None, map(str.strip, (text or "").split("\n\n"))):
            if len(paragraph) > most:
                out += ["\n\n".join(open_).strip()] * bool(open_) + long_paragraph(paragraph)
                open_ = []
                continue
            if open_ and len("\n\n".join([*open_, paragraph])) > most:
                full = "\n\n".join(open_)
                out.append(full.strip())
                open_ = [full[-overlap:]] if overlap else []
            open_.append(paragraph)
        return out + ["\n\n".join(open_).strip()] * bool(open_)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunk(texts: pd.Series) -> pd.Series:
        return texts.map(split, na_action=None)

    return chunk
