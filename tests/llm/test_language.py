"""Language ID: held-out accuracy, mixed texts, Viterbi against all paths."""

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from pagewarden.llm import language
from pagewarden.llm.queries import QUERIES, held_out
from tests.llm.fixtures import edge_docs, empty_docs, sf


def test_held_out_accuracy(spark):
    found = QUERIES["op2_language"](spark, "/root/testdata/sf0.01")
    rows = found.join(sf(spark, at="0.01").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_spans_of_mixed_text(spark):
    rows = [("en", "the house of the king and the queen with this that which there"), ("de", "der könig und die königin mit dem haus nicht auch sich"), ("ru", "король и королева в доме не там где всегда")] * 3
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.langs == ["de", "en", "ru"] and model.scripts["cyrillic"] == [False, False, True]
    text = "there the queen with the king und der könig nicht mit dem haus король в доме"
    r = language.predict(spark.createDataFrame([(1, text)], "doc_id int, text string"), model).first()
    assert [s.lang for s in r.spans] == ["en", "de", "ru"] and sum(s.words for s in r.spans) == 16
    assert r.lang_pred == "de" and abs(r.score - r.spans[1].letters / sum(s.letters for s in r.spans)) < 1e-9


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b", "c"], {}, np.zeros((1, 3)), {}, switch=1.5)
    texts = [[f"{'xyz'[i % 3]}{chr(97 + j)}" for j in range(n)] for i, n in enumerate([5, 0, 1, 7, 5])]
    words = sorted({w for t in texts for w in t})
    model.word_rows(words)
    model._table[: len(words)] = rng.normal(size=(len(words), 3)) * 2
    got = model.label(texts)
    for text, path in zip(texts, got, strict=True):
        def value(p, text=text):
            return sum(model._table[model._at[w], k] for w, k in zip(text, p, strict=True)) - 1.5 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        assert len(path) == len(text)
        if text:
            assert abs(value(path) - max(value(p) for p in product(range(3), repeat=len(text)))) < 1e-4


def test_edges(spark):
    docs = edge_docs(spark)
    model = language.fit(docs)
    rows = language.predict(docs, model).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in (0, 1, 2, 9)] == ["und"] * 4 and by_id[0].score == 0 and by_id[4].lang_pred == "en"
    nothing = language.fit(empty_docs(spark))
    assert nothing.langs == [] and {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(empty_docs(spark), model).count() == 0
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.lang_pred != "und"}


def test_training_never_sees_held_out_rows(spark):
    docs = sf(spark).withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in language.fit(docs.filter(~held_out())).langs
