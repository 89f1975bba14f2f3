"""The pipeline's stages, each against a plain version over what its predecessor kept."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline as cp
from memspark.llm import fm, mixing, packing, quality_rules
from memspark.llm.common import cut, read
from memspark.llm.shingles import shingle_set

from .test_packing import plain_best_fit
from .test_simhash import components


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """The rows before the first stage and after each."""
    docs = read(spark, sf_dir, "documents")
    frames = [docs]
    for _, stage in cp.STAGES:
        frames.append(cut(stage(spark, frames[-1], sf_dir)))
    return frames


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def in_duck(df, sql):
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    return con.execute(sql).df()


def test_all_but_the_last_return_the_columns_of_documents(kept):
    assert len(cp.STAGES) == 5
    assert all(sorted(df.dtypes) == sorted(kept[0].dtypes) for df in kept[:-1])
    assert all(0 < b.count() <= a.count() for a, b in zip(kept[:3], kept[1:4]))


def test_classifier_keeps_what_the_plain_score_keeps(spark, sf_dir, kept):
    model = fm.fit_sample(kept[0], read(spark, sf_dir, "labels"), held=None)
    want = Counter()
    for r in kept[0].collect():
        at, x = fm.features(r.text)
        v = model.v[at] * x[:, None]
        pairs = v @ v.T
        z = model.bias + model.w[at] @ x + (pairs.sum() - np.trace(pairs)) / 2
        want[r.doc_id] += z >= 0
    assert ids(kept[1]) == +want


def test_rules_keep_what_the_sql_keeps(kept):
    out = in_duck(kept[1], quality_rules.ORACLE_SQL)
    assert ids(kept[2]) == Counter(out[out.kept].doc_id.tolist())


def test_one_of_each_group_of_near_copies_stays(kept):
    """Near copies are texts whose sets of 5-word shingles have a similarity of 0.8 or more."""
    sets = {r.doc_id: set(shingle_set(r.text).tolist()) for r in kept[2].collect()}
    least = components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * max(1, len(sets[a] | sets[b])))
    assert ids(kept[3]) == Counter(d for d in sets if least[d] == d)


def test_mixture_is_what_the_sql_says(kept):
    sql = mixing.ORACLE_SQL.replace("500 // 1000", f"{cp.SHARE} // 1000").replace("sum(n_tokens)::bigint * 2 AS cap", "sum(n_tokens)::bigint * 1 AS cap")
    out = in_duck(kept[3], sql)
    assert ids(kept[4]) == +Counter({r.doc_id: int(r.copies) for r in out.itertuples()})


def test_packing_is_plain_best_fit(kept):
    rows, bins = kept[5].collect(), defaultdict(list)
    docs = {r.doc_id: r for r in kept[4].collect()}
    assert sum(r.n_tokens for r in rows) == sum(len(d.text.encode().split()) for d in docs.values())
    order = sorted(rows, key=lambda r: (-r.n_tokens, r.doc_id, r.piece))
    assert len({r.bin_id >> 32 for r in rows}) == 1
    got = [(r.bin_id & 0xFFFFFFFF, r.start) for r in order]
    assert got == plain_best_fit([(r.n_tokens, docs[r.doc_id].source, docs[r.doc_id].text if r.n_tokens else None) for r in order], packing.CAPACITY)
    for r in rows:
        bins[r.bin_id].append(r)
    assert all(sum(r.n_tokens for r in b) <= packing.CAPACITY for b in bins.values())


def test_run_gives_the_last_stage(spark, sf_dir, kept):
    assert sorted(map(tuple, cp.run(spark, sf_dir).collect())) == sorted(map(tuple, kept[5].collect()))


def test_nulls_repeats_empty_tables_and_clashing_columns(spark, sf_dir):
    base = read(spark, sf_dir, "documents")
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text, None, None), (900001, None, "en", "s"), (900002, "", None, "s"), (900003, text, "en", None), (900003, text, "en", None), (900004, "a " * 30000, "de", "s")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", cp.F.length("text").cast(base.schema["n_chars"].dataType))
    docs = base.unionByName(odd).withColumn("score", cp.F.lit("x")).withColumn("kept", cp.F.lit(1)).withColumn("_row", cp.F.lit(2.0))
    for _, stage in cp.STAGES[:4]:
        out = cut(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    packed = cp.pack(spark, docs, sf_dir)
    assert packed.count() >= docs.count() and cp.pack(spark, docs.limit(0), sf_dir).count() == 0
    one = {r.doc_id for r in cp.near_copies(spark, odd, sf_dir).collect()}
    assert one == {900001, 900003, 900004}
