"""Rows that every corpus operator has to stand."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
TEXTS = [None, "", " \t\n", "one", "One  two\nthree four five six", "one two three four five six", LONG, LONG, "été été. 漢字 " + "x" * 5000, "42 %% 17", "\x00 <|endoftext|> ▁ a\x85b"]


def edge_docs(spark):
    """Null and empty texts, a null id, a repeated row, ties, and columns named like inner ones."""
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(TEXTS)] + [(3, "one", "en"), (None, "one two three", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    clash = "row group n chunk ended rest sha head signature next_text block guest tree key a b digest low n_shingles tokens score page removed size".split()
    return docs.select("*", *[F.lit(7).alias(c) for c in clash])


def empty_docs(spark):
    return edge_docs(spark).limit(0)


def sf(spark, name="documents", at="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{at}/{name}.parquet")


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
