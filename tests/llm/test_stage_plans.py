"""A stage that keeps rows by what a Python function returns calls that function once for each text."""

import corpus_pipeline
import pytest
from kdframe.llm import decontaminate, line_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    rows = [(i, f"line of {i} words here\nthe same line in every text", "en", "web", 1) for i in range(20)]
    return spark.createDataFrame(rows, DOCS)


def test_line_stage(spark, docs, capsys):
    kept = corpus_pipeline.line_stage(spark, docs, None)
    kept.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    assert kept.where("text like '%same line%'").count() == 1 and kept.where("n_chars != length(text)").isEmpty()


def test_decontamination(spark, docs, capsys):
    hit = " ".join(f"w{chr(97 + i)}" for i in range(13))
    benchmark = spark.createDataFrame([("b1", hit)], "item_id string, text string")
    more = spark.createDataFrame([(50, f"start {hit} " + "other words " * 300, "en", "web", 1), (51, hit, "en", "web", 1)], DOCS)
    kept = decontaminate.decontaminate(docs.union(more), benchmark)
    kept.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    found = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 51 not in found and hit not in found[50] and len(found) == 21
