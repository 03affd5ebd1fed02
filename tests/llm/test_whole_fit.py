"""Language models of all texts to learn from."""

import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from scriptorium.llm import lang_id  # noqa: E402


def test_language_counts_come_from_all_texts(spark, monkeypatch):
    """No text to learn from is left out; a larger corpus gives the same counts, over its size."""
    rows = [(k, f"number {k} of this language " * 20, "en") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = [t for k, t, _ in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    size = sum(map(len, own))
    assert size > lang_id.SCALE and lang_id.sampled(df).count() == len(own)
    counts = lang_id.fit(df)
    letters = counts[counts["ord"] == 0].set_index("gram")["n"]
    assert all(np.isclose(letters[ord(c)], sum(t.count(c) for t in own) * lang_id.SCALE / size) for c in "7nu ")  # of 400 texts before
    assert 3 <= counts[counts["ord"] == 3].groupby(counts["gram"] // 256)["n"].sum().min() and counts["n"].min() >= 1
    monkeypatch.setattr(lang_id, "SORTED", 5000), monkeypatch.setattr(lang_id, "KEPT", 50)
    again = lang_id.fit(df).set_index(["ord", "gram"])["n"].sort_index()
    assert again.equals(counts.set_index(["ord", "gram"])["n"].sort_index())
