"""The answer cache over runs."""

from gleanery.operators.cache import PromptCache

asked = []


def test_rounds(spark, tmp_path):
    path = str(tmp_path / "it's a cache")
    prompts = lambda *texts: spark.createDataFrame([(i, t, "m", None, "k", "x") for i, t in enumerate(texts)], "id long, prompt string, model string, system string, cache_key string, _p string")

    def answer(batch):
        return batch.assign(text=[None if p == "bad" else f"A {p}" for p in batch["prompt"]])[["cache_key", "text"]]

    first = PromptCache(spark, "cache_one", path, 4).answers(prompts("a", "b", "a", "bad", None), answer)
    assert sorted((r.id, r.text, r.from_cache) for r in first.collect()) == [(0, "A a", False), (1, "A b", False), (2, "A a", False), (3, None, False), (4, "A None", False)]
    again = PromptCache(spark, "cache_two", path, 4)
    got = again.answers(prompts("b", "c", "bad"), lambda b: b.assign(text="other")[["cache_key", "text"]])
    assert sorted((r.id, r.text, r.from_cache, r.cache_key) for r in got.collect()) == [(0, "A b", True, "k"), (1, "other", False, "k"), (2, "other", False, "k")]
    assert again.stored().count() == 5
    # stored twice, read once
    spark.table("cache_two").limit(2).write.insertInto("cache_two")
    assert again.stored().count() == 5
    assert again.answers(prompts("b").limit(0), answer).count() == 0
    plan = again.stored()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
