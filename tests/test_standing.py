"""Standing queries: kept, listed, run and refused."""

import pytest

from memspark.operators import standing as sd


def test_the_last_version_of_a_standing_query_runs(spark, tmp_path):
    facts = spark.createDataFrame([(i, f"u{i % 2}", f"key{i}", "some Value" if i % 3 else "other", i / 10, i) for i in range(10)], "entry_id long, user_id string, key string, value string, importance double, created_at long")
    folder = str(tmp_path)
    assert sd.listed(spark, folder).count() == 0
    sd.save(spark, folder, "mine", {"importance_min": 0.8})
    sd.save(spark, folder, "mine", {"description": "values", "content_like": "VALUE", "importance_min": 0.3, "limit": 3})
    sd.save(spark, folder, "all_2", {})
    assert {tuple(r) for r in sd.listed(spark, folder).collect()} == {("mine", "values"), ("all_2", "")}
    assert [r.entry_id for r in sd.run(spark, folder, "mine", {"core": facts}).collect()] == [8, 7, 5]
    assert [r.entry_id for r in sd.run(spark, folder, "mine", {"core": facts}, "u1").collect()] == [7, 5]
    assert sd.run(spark, folder, "all_2", {"core": facts.limit(0)}).count() == 0
    with pytest.raises(ValueError, match="unknown standing"):
        sd.run(spark, folder, "gone", {"core": facts})
    sd.save(spark, folder, "eps", {"source": "episodes"})
    with pytest.raises(ValueError, match="isn't given"):
        sd.run(spark, folder, "eps", {"core": facts})


@pytest.mark.parametrize("name", ["", "../up", "a b", "x" * 101, "-_-", "a\n"])
def test_hostile_names_and_unknown_filters_are_refused(name):
    with pytest.raises(ValueError, match="invalid name"):
        sd.checked(name, {})
    with pytest.raises(ValueError, match="unknown filters"):
        sd.checked("fine", {"user_id": "u", "where": "1 = 1"})
