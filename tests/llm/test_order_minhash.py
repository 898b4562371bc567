"""Order MinHash against a plain version, and what it must and must not notice."""

from collections import Counter

import duckdb
import xxhash
from pyspark.sql import functions as F

from pagewarden.llm import order_minhash as omh
from tests.llm.fixtures import edge_docs, empty_docs, sf, texts_of

BINS, PER_BIN, K = 16, 2, 2
MASK = (1 << 64) - 1


def _chain(values):
    seed = 42
    for v in values:
        data = v if isinstance(v, bytes) else (v & MASK).to_bytes(8, "little") if abs(v) >= 2**31 or isinstance(v, Long) else (v & 0xFFFFFFFF).to_bytes(4, "little")
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed


class Long(int):
    pass


def plain(text):
    """Tuples of (bin, rank) identities per bin."""
    words = [w.encode() for w in text.split(" ")]
    n = max(1, len(words) - K + 1)
    kmers = [_chain(words[i : i + K]) >> omh.PLACE_BITS for i in range(n)]
    kmers = [h - (1 << 36) if h >> 35 else h for h in kmers]
    seen, found = Counter(), []
    for place, kmer in enumerate(kmers):
        h = _chain([Long(kmer), seen[kmer]])
        seen[kmer] += 1
        signed = h - (1 << 64) if h >> 63 else h
        found.append((signed % BINS, h >> (64 - omh.RANK_BITS), place))
    found.sort()
    out = []
    for b in range(BINS):
        start = sum(x[0] < b for x in found)
        lowest = found[start : start + PER_BIN]
        lowest += found[: PER_BIN - len(lowest)]
        out.append(tuple(x[:2] for x in sorted(lowest, key=lambda x: x[2])))
    return out


def _signatures(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: r.signature for r in omh.fingerprints(rows, bins=BINS, per_bin=PER_BIN).collect()}


def test_equal_places_are_those_of_the_plain_version(spark):
    texts = [t for _, t in texts_of(sf(spark)) if len(t) < 3000][:25] + ["", " ", "a", "a a a a a a b a a", "a a a b a a a", "x y z " * 50, "x y z " * 50 + "w"]
    texts += [t[: len(t) // 2] + " new words here " + t[len(t) // 2 :] for t in texts[:10]]
    got, want = _signatures(spark, texts), [plain(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert [x == y for x, y in zip(got[i], got[j], strict=True)] == [x == y for x, y in zip(want[i], want[j], strict=True)], (texts[i][:40], texts[j][:40])


def test_order_and_edits_count(spark):
    words = [f"w{i}" for i in range(400)]
    swapped = " ".join(words[200:] + words[:200])
    one_edit = " ".join(words[:100] + ["new"] + words[101:])
    rows = spark.createDataFrame([(" ".join(words), swapped, one_edit)], "t string, s string, e string")
    sig = {c: omh.signature(F.col(c)) for c in "tse"}
    r = rows.select(*[v.alias(k) for k, v in sig.items()]).select(omh.likeness(F.col("t"), F.col("t")).alias("same"), omh.likeness(F.col("t"), F.col("s")).alias("moved"), omh.likeness(F.col("t"), F.col("e")).alias("edit")).first()
    assert r.same == 1 and r.edit > 0.9 and r.moved < 0.7


def test_order_counts_in_short_texts_too(spark):
    """A moved half of a text of any length leaves about half of the places."""
    rows = []
    for n in (20, 30, 40, 60, 100, 400):
        for copy in range(12):
            words = [f"w{copy}x{i}" for i in range(n)]
            rows.append((n, " ".join(words), " ".join(words[n // 2 :] + words[: n // 2]), " ".join(words[:-1] + ["new"])))
    df = spark.createDataFrame(rows, "n int, t string, s string, e string")
    sig = df.select("n", *[omh.signature(F.col(c)).alias(c) for c in "tse"])
    mean = sig.groupBy("n").agg(F.avg(omh.likeness(F.col("t"), F.col("s"))).alias("moved"), F.avg(omh.likeness(F.col("t"), F.col("e"))).alias("edited")).collect()
    for r in mean:
        assert 0.3 < r.moved < 0.68 and r.edited > 0.75 and r.edited > r.moved + 0.15, r


def _expected_edits(docs):
    rows = sorted(texts_of(docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (doc, text) in enumerate(rows):
        third, following = len(text) // 3, rows[(i + 1) % len(rows)][1]
        out.append((doc, len(text), text[: len(text) - third] + following[:third]))
    return out


def test_edited_texts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    for docs in (sf(spark), sf(spark).filter("doc_id % 7 = 1").withColumn("doc_id", F.col("doc_id") * 10**15), edge_docs(spark), edge_docs(spark).filter("doc_id = 4")):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in omh.edited_likeness(docs).collect())
        con = duckdb.connect()
        want = sorted((d is None, d or 0, n, con.execute("select sha256(?)", [e]).fetchone()[0]) for d, n, e in _expected_edits(docs))
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_likeness_of_edits_and_plan(spark):
    found = omh.edited_likeness(sf(spark))
    rows = found.collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian"))
    by_text = sf(spark).join(found, "doc_id").groupBy("text").agg(F.count_distinct("fingerprint").alias("n"))
    assert by_text.filter("n > 1").isEmpty()
    assert omh.edited_likeness(empty_docs(spark)).count() == 0
    alone = omh.edited_likeness(edge_docs(spark).filter("doc_id = 4")).first()
    assert alone.near_next == 1.0
