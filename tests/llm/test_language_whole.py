"""Language ID learns every label and every word, however its model is laid out."""

import pytest
from pyspark.sql import functions as F

from listwright.llm import language


def test_every_label_is_learned(spark):
    names = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(230)]
    rows = [(n, f"{n}word {n}word {n}other") for n in names]
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == names
    assert [model.predict([t])[0][0] for _, t in rows] == names


def test_rare_words_are_known(spark):
    rows = [("en", "common " * 150_000 + "once"), ("de", "haus " * 1000)]
    assert "once" in language.fit(spark.createDataFrame(rows, "lang string, text string")).words


@pytest.mark.parametrize("most", [0, 300])
def test_joined_model_answers_as_the_whole_one(spark, documents, monkeypatch, most):
    docs = documents.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame([(-1, None, None), (-2, "12 !", None), (-3, "Ωμέγα 你好 xqzv", None), (-4, "", "en")],
                              "doc_id long, text string, lang string"))
    whole = language.learn(docs)
    want = {r["doc_id"]: r["a"] for r in docs.select("doc_id", language.predicted(spark, whole, F.col("text")).alias("a")).collect()}
    monkeypatch.setattr(language, "MODEL_BYTES", most * (language.UNIT_BYTES + 4 * len(whole.languages)))
    model = language.learn(docs)
    assert model.rest is not None and len(model.words) <= most
    got = language.identified(docs, model).select("row.doc_id", "answer").collect()
    assert len(got) == len(want) == docs.count()
    for r in got:
        a, b = r["answer"].asDict(), want[r["doc_id"]].asDict()
        assert a.pop("score") == pytest.approx(b.pop("score"), abs=1e-4)
        assert a == b


def test_words_are_written_once_and_rows_wait_apart(spark, documents, monkeypatch):
    """Of a model that is not whole, the texts' words are in one table; nothing but that table has the rows; a spent model's
    tables are gone."""
    docs, tables = documents.select("doc_id", "text", "lang"), {}
    written = language.written

    def noted(df, label):
        tables.setdefault(label, []).append(df)
        return written(df, label)

    monkeypatch.setattr(language, "MODEL_BYTES", 300 * (language.UNIT_BYTES + 16))
    model = language.learn(docs)
    monkeypatch.setattr(language, "written", noted)
    found = language.identified(docs, model, spent=True)
    assert [label for label, dfs in tables.items() if "row_id" in dfs[0].columns] == ["scanned-texts", "language-answers"]
    assert [label for label, dfs in tables.items() if "row" in dfs[0].columns] == ["scanned-texts"]
    assert found.filter("row.text is not null").count() == docs.filter("text is not null").count()
    for df in (model.rest.words, model.rest.grams):
        with pytest.raises(Exception):
            df.count()
