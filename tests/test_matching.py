"""Patterns in texts against looking for each in each; rules, hints and feelings in edge cases."""

import random

from pyspark.sql import functions as F

from memspark.operators import matching as mt


def test_occurrences_equal_looking_for_each_pattern(spark):
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("abä😀") for _ in range(k))
    texts = [(i, word(rng.randrange(60))) for i in range(150)] + [(7, "abab"), (7, "abab"), (None, "aba"), (900, None), (901, "")]
    patterns = sorted({word(rng.randrange(1, 5)) for _ in range(60)} | {"aba", "zzz"})
    count = lambda t, p: sum(t.startswith(p, k) for k in range(len(t)))
    want = sorted(((i, p, count(t, p), t.index(p)) for i, t in texts if t for p in patterns if p in t), key=str)
    df = spark.createDataFrame([(*r, "x") for r in texts], "id long, text string, pattern string")
    asked = spark.createDataFrame([(p,) for p in [*patterns, *patterns, "", None]], "pattern string")
    for chars in (mt.GROUP_CHARS, 30):
        got = mt.occurrences(df, ["id"], "text", asked, group_chars=chars).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert mt.occurrences(df, ["id"], "text", asked.limit(0)).collect() == []


def test_disclosures_of_enabled_rules_newest_first(spark):
    rules = spark.createDataFrame(
        [(1, "u", "a", ["Tea"], True), (2, "u", "b", ["milk", "tea"], True), (3, "u", "c", ["tea"], False), (4, "u", "d", ["sugar"], True), (5, "u", "e", ["tea"], True), (6, "v", "f", ["tea"], True), (7, "u", "g", [], True)],
        "rule_id long, user_id string, name string, keywords array<string>, enabled boolean",
    )
    texts = spark.createDataFrame([(1, "u", "TEA with sugar"), (2, "v", "steam"), (3, "u", None), (4, "w", "tea"), (5, "u", "milk")], "id long, user_id string, text string")
    told = lambda **kw: sorted((r.id, r.rule_id, r.place) for r in mt.disclosures(texts, rules, "id", **kw).collect())
    assert told() == [(1, 2, 3), (1, 4, 2), (1, 5, 1), (2, 6, 1), (5, 2, 1)]
    assert told(newest=3) == [(1, 4, 2), (1, 5, 1), (2, 6, 1)]


def test_blank_queries_get_all_routes(spark):
    df = spark.createDataFrame([(1, " "), (2, None), (3, "please RECALL how to resume for now"), (4, "none")], "id int, query string")
    got = {}
    for r in sorted(mt.steering_hints(df, "id").collect(), key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append(r.route)
    names = [n for n, _ in mt.ROUTES]
    assert got == {1: names, 2: names, 3: names[:3]}


def test_feelings_of_overlapping_phrases_and_word_bounds(spark):
    texts = ["I truly LOVE you", "clover sadness", "wow!", "я счастлив тебя люблю", "Рад!", "thank you 🙏", None, "", "i miss you dear ❤️"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", mt.feelings(F.col("text")).alias("f")).collect()
    got = {r.id: [(x.feeling, x.score, x.source) for x in r.f] for r in rows}
    assert got == {0: [("love", 0.8, "phrase")], 1: [], 2: [("surprise", 0.4, "word")], 3: [("joy", 0.4, "word"), ("love", 0.8, "phrase")], 4: [("joy", 0.4, "word")], 5: [("gratitude", 0.4, "word")], 6: [], 7: [], 8: [("love", 0.8, "phrase")]}
    kept = spark.createDataFrame([(1, "Ok!!"), (2, "why? why? why?"), (3, "x" * 301 + "!!"), (4, "great!!")], "id int, text string").select("id", mt.save_trigger(F.col("text")).alias("t")).collect()
    assert {r.id: r.t and tuple(r.t) for r in kept} == {1: None, 2: ("complex_question", 0.4), 3: ("long_message", 0.3), 4: ("emotion_joy", 0.4)}


def test_sources_of_recall_compare_no_row_with_every_word(spark, sf_dir):
    from memspark.plans import stewards

    plan = stewards.multi_source_search(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
