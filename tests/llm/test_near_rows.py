"""One row of each class of near duplicates stays, whatever its id."""

from pyspark.sql import functions as F

from listwright.llm import near_dedup


def test_one_row_of_each_class_stays(spark):
    words = [f"w{k}" for k in range(60)]
    text, near = " ".join(words), " ".join(words[:-1] + ["other"])
    rows = [(1, text, "a"), (1, text, "b"), (1, near, "c"), (2, text, "d")]
    rows += [(None, "null " + " ".join(reversed(words)), "e")] * 5
    rows += [(7, None, "f"), (7, None, "f"), (None, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len([r for r in got if r["text"] and r["doc_id"] == 1]) == 1
    assert not [r for r in got if r["doc_id"] == 2]
    assert len([r for r in got if r["source"] == "e"]) == 1
    assert len([r for r in got if not r["text"]]) == 3  # texts without words are each a class
    assert near_dedup.near_duplicates(docs).filter("kept").count() == len(got)
