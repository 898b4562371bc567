"""The pipeline against a plain version of its stages, and its registration."""

import re

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm.fixtures import sf, texts_of
from tests.llm.test_dedup import brute


def test_run_equals_the_plain_stages(spark):
    docs = [(d, t) for d, t in texts_of(sf(spark)) if any(c.isalpha() for c in t)]
    first = {}
    for doc, text in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text), (doc, text))
    near = brute(first.values(), 80)
    kept = {d: t for d, t in first.values() if near[d][2]}
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in kept.items()}
    assert max(r.offset + r.length for r in rows) <= 2048


def test_stages_return_the_columns_of_documents(spark):
    docs = sf(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == sf(spark).columns


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
