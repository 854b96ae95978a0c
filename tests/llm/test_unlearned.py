"""Language ID rejects longer documents in a script that was never learned, with or without spaces."""

import pytest

import corpus_pipeline

SENTENCES = {
    "en": "the house stands near the river and the children play there every day",
    "de": "das Haus steht am Fluss und die Kinder spielen dort an jedem Tag",
    "fr": "la maison est pres de la riviere et les enfants y jouent chaque jour",
    "es": "la casa esta cerca del rio y los ninos juegan alli todos los dias",
}


@pytest.mark.parametrize("n", [2, 4])
def test_unlearned_scripts_are_rejected(spark, n):
    rows = [(i, f"{SENTENCES[lang]} {SENTENCES[lang]} {i}", lang) for i, lang in enumerate(list(SENTENCES)[:n] * 20)]
    learned = {r[0] for r in rows}
    rows += [(1000, "漢字文章" * 100, None), (1001, "слово другое " * 40, None), (1002, "ไทย" * 100, None)]
    rows += [(1003, "漢字", None), (1004, "αβγ δεζ", None)]  # too short to reject
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert got == learned | {1003, 1004}
