"""Grams and urls are joined in the executors: nothing that grows with them is sent to the driver to be broadcast."""

from pyspark.sql import functions as F

from listwright.llm import url_filter


def test_nothing_is_broadcast(spark):
    rows = [(k, f"{k % 7}host{k}.example.com/en/{k * 37}", ("allow", "block", None)[k % 3]) for k in range(200)]
    urls = spark.createDataFrame(rows, "key long, scored string, ruled string").withColumn("trains", F.col("ruled").isNotNull())
    ratios = url_filter.gram_ratios(url_filter.count_grams(urls))
    scored = url_filter.score_urls(urls, ratios)
    assert sorted(r["key"] for r in scored.collect()) == [k for k, *_ in rows]
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "ShuffledHashJoin" in plan
    assert "Broadcast" not in plan


def test_urls_meet_their_scores_without_a_broadcast(spark, monkeypatch):
    plans, write = [], url_filter.written

    def seen(df, label):
        if label == "url-scores":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(url_filter, "written", seen)
    rows = [(k, f"http://{k}.example.com/en/{k}") for k in range(50)] + [(50, None), (50, None)]
    assert url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).count() == 52
    assert len(plans) == 1 and "Broadcast" not in plans[0]
