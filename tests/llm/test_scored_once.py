"""What the pipeline's language stage asks of Python workers."""

import pytest

pytest.importorskip("public_tokenizers")

from scriptorium.llm import lang_id  # noqa: E402


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_scored_once(spark, monkeypatch):
    """A filter on the prediction stays above it: below, it would score the texts once more in a second worker (as it did, in both steps)."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plans, collect = [], type(table).collect

    def seen(df):
        plans.append(plan(df))
        return collect(df)

    monkeypatch.setattr(type(table), "collect", seen)
    kept = lang_id.in_language(table)
    monkeypatch.undo()
    assert max(p.count("ArrowEvalPython") for p in plans) == 2  # each half of the texts under the model of the other
    assert plan(kept).count("ArrowEvalPython") == 1
    assert "ExistingRDD" not in plan(kept)  # limits need no Python worker
    assert 0 < kept.count() <= table.count()
