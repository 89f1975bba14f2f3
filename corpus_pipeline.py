"""A corpus pipeline of five operators: classify, apply rules, drop near copies, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
All stages but the last return the columns of documents, in their order, and no others, whatever
further columns docs has. Null ids, texts, languages and sources are values like others unless a
stage says otherwise; an empty table goes through all stages and gives no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import fm, mixing, packing, quality_rules, shingles
from memspark.llm.common import cut, read, scratch_dir

#: Share of the kept tokens that goes into the mixture, in thousandths.
SHARE = 900
#: Ids of documents that go, up to which they are broadcast.
BROADCAST_IDS = 1_000_000


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the factorisation machine predicts to be good (all labelled rows may be learned from).

    Null and empty texts are scored like texts without words. Rows that repeat share their fate. Without labels all stay."""
    model = fm.fit_sample(docs, read(spark, sf_dir, "labels"), held=None)
    return fm.keep_good(docs, model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents within the limits of their language and source.

    Texts of under ten words (null and empty ones too) go. Values equal to a limit stay; rows that repeat share their fate."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of near copies (similarity 0.8 or more of 5-word shingles).

    Of repeated rows with that doc_id all stay; rows without an id stay only where no row of the component has one."""
    found = shingles.near_copies(docs)
    gone = cut(found.filter("doc_id is null and component_id is not null or doc_id <> component_id").select("doc_id").distinct())
    # Ids are broadcast up to a number; beyond it texts are shuffled with them.
    some = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(some, docs["doc_id"].eqNullSafe(some["doc_id"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the budgets of domains, languages and sources choose, each once.

    Texts without words cost nothing and follow their order; rows that repeat are chosen each for itself."""
    return mixing.take(docs, mixing.production_mix(SHARE, 1))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, bin_id, start. A text without words is one piece of 0 tokens."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("SimHash near-dedup", near_copies),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]

#: The classifier and the near copies can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(path := scratch_dir(spark, f"stage{k}"))
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
