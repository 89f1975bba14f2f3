"""Quality rules against plain Python."""

import math
import random
from collections import Counter

import duckdb

from memspark.llm import quality_rules as qr

BLANK = " \t\n\x0b\f\r"


def plain(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts_match_plain_python(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c", "x\r\ny\x0bz\fq", "\n\na b\na b\n \n \n", "a b c d e a b c d e f", "é ß 😀 # a|b <x>", "w " * 4000]
    texts += [rng.choice(["", " ", "\n"]).join("".join(rng.choice("ab #\n\t é") for _ in range(9)) for _ in range(rng.randrange(20))) for _ in range(80)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, None, "s", 7, True) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int, kept boolean")
    got = {r.doc_id: r for r in qr.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert len(got) == len(texts)


def test_fences_keep_clean_rows_and_drop_outliers(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 8))) for _ in range(80)), rng.choice(["en", None]), rng.choice("st"), 1) for i in range(600)]
    rows += [(1000 + i, " ".join(f"w{i}x{j}$$$" for j in range(60)), "en", "s", 1) for i in range(40)]
    rows += [(2000 + i, " ".join(f"{i}" * 30 + str(j) for j in range(50)), None, "rare", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _lang int")
    kept = qr.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids <= set(range(600)) and len(ids) >= 580


def test_a_symbol_in_some_texts_is_no_junk(spark):
    """A tenth of the rows holds one symbol, so both quartiles are 0; those rows stay, rows full of symbols go."""
    rng = random.Random(4)
    words = lambda n: [rng.choice(["some", "plain", "word", "here"]) + str(rng.randrange(10**6)) for _ in range(n)]
    rows = [(i, " ".join(words(rng.randrange(12, 200)) + (["5%"] if i % 10 == 0 else [])), "en", "s") for i in range(1000)]
    rows += [(5000 + i, " ".join(w + "#$" for w in words(60)), "en", "s") for i in range(30)]
    kept = {r.doc_id for r in qr.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i in range(1000) if i % 10 == 0} <= kept
    assert not kept & set(range(5000, 5030))


def test_an_exponential_tail_loses_the_asked_for_share(spark):
    for q in (0.75, 0.99):
        limit = -math.log(1 - q) + qr.reach(q) * math.log(q / (1 - q))
        assert math.isclose(math.exp(-limit), qr.REJECT)


def test_leaves_with_limits_of_their_own_match_the_sql(spark, tmp_path):
    """Three leaves of over 100 rows each, of which 5 % are outliers of one measure or another."""
    rng, rows = random.Random(7), []
    for i in range(900):
        size = 3 + 2 * (i % 3)
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(size - 1, size + 2))) for _ in range(rng.randrange(40, 90))]
        odd = rng.randrange(80)
        words = [w * 4 for w in words] if odd == 0 else [w + "#$" for w in words] if odd == 1 else words
        text = " ".join(words) + ("\nsame line" * 9 if odd == 2 else "") + (" one more two more go" * 2 if odd == 3 or odd > 76 else "")
        rows.append((i, text, "en" if i % 3 else None, f"s{i % 3}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in qr.quality_rules(docs).collect()}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {r.doc_id: (bool(r.base_failed), bool(r.kept)) for r in con.execute(qr.ORACLE_SQL).df().itertuples()}
    assert got == want
    failed = [i for i, (b, k) in got.items() if not b and not k]
    assert 15 < len(failed) < 60
    assert {r.doc_id for r in qr.keep_good(docs).collect()} == {i for i, (_, k) in got.items() if k}


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert qr.quality_rules(spark.createDataFrame([], schema)).count() == 0
    assert qr.keep_good(spark.createDataFrame([], schema)).count() == 0
    row = (None, "one two three four five six seven eight nine ten eleven", None, None)
    assert [r.kept for r in qr.quality_rules(spark.createDataFrame([row, row], schema)).collect()] == [True, True]


def test_main_path_runs_no_python(spark, sf_dir):
    plan = qr.op4_quality_rules(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
