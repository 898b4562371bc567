"""Prefix trie, divergence audit and de Bruijn compaction against SQL and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewarden.llm import debruijn, divergence, prefix_trie
from pagewarden.llm.queries import ORACLES, QUERIES
from pagewarden.llm.words import Words
from tests.llm.fixtures import LONG, edge_docs, empty_docs

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_divergence", "op13_debruijn"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def plain_trie(rows):
    """The trie of rows (conv_id, turn, role, text) after the fork, by walking it."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        turns = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, d == len(turns)))
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[k] for k in kids[node])
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, end in m if end))
        parent = min(members[node[:-1]])[0] if node else None
        out.append((min(m)[0], len(node), parent, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(spark, rows):
    docs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return docs.select("*", *[F.lit(7).alias(c) for c in "place row block p1 p2 q1 depth bytes k c d pc pd base h n".split()])


def trie_of(spark, rows, **options):
    got = prefix_trie.trie(*prefix_trie.forked(prefix_trie.ordered(conversations(spark, rows))), **options)
    assert got.columns == prefix_trie.OUT
    return sorted(map(tuple, got.collect()), key=repr)


def test_trie_equals_walk(spark):
    """Shared starts, ties in turn, nulls everywhere, negative ids, turnless and long conversations, a hot one."""
    rng = random.Random(3)
    rows = [(None, 0, "user", "lost"), (4, None, None, None), (4, None, "a", None), (4, 2, "user", "é" * 40), (4, 2, "user", "é" * 40)]
    for c in [*range(-7, 40), 2**62]:
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["", "x", "yes", LONG[:50]])) for t in range(rng.randrange(1, 12))]
    rows += [(c, t, "user", f"turn {t}") for c in (100, 105, 110) for t in range(70)]
    rows += [(c, 0, "user", "hot") for c in range(1000, 1600)]
    want = plain_trie(rows)
    assert trie_of(spark, rows) == want
    assert trie_of(spark, rows, block=5) == want


def test_trie_of_nothing(spark):
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "user", "x")]) == []
    assert trie_of(spark, [(3, None, None, None)]) == plain_trie([(3, None, None, None)])


def test_totals_of_odd_trees(spark):
    """A star, a chain and random trees: every subtree sum."""
    rng = random.Random(5)
    shapes = {"star": [0] * 200, "chain": list(range(90)), "mixed": [rng.randrange(max(0, i - 3), i + 1) for i in range(150)]}
    for parents in shapes.values():
        depth, total = [0], [1]
        for i, p in enumerate(parents, 1):
            depth.append(depth[p] + 1)
            total.append(i + 1)
        weights = total[:]
        for i in range(len(parents), 0, -1):
            total[parents[i - 1]] += total[i]
        kids = Counter(parents)
        rows = [(i, depth[i], parents[i - 1] if i else None, depth[i] - 1 if i else None, kids[i], weights[i]) for i in range(len(parents) + 1)]
        nodes = spark.createDataFrame(rows, "c bigint, d bigint, pc bigint, pd bigint, n_children bigint, w bigint")
        assert {r.c: r.w for r in prefix_trie.subtree_totals(nodes, ["w"]).collect()} == dict(enumerate(total))


def plain_audit(rows, min_docs, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for x, s in counts if x == lang]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(q[t] - p[s][t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


def test_audit_equals_plain(spark):
    rng = random.Random(11)
    words = ["the", "The", "été", "漢字漢字漢字", "internationalisation", "international", "inter", "a", "zz" * 40, "zz" * 40 + "y"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", None]), " ".join(rng.choices(words, k=rng.randrange(6)))) for _ in range(150)]
    rows += [("en", "s1", "The <b>THE</b> l'été 42"), ("xx", "alone", "once"), ("xx", "other", None), ("en", "hot", LONG)] + [("en", "hot", "hot hot inter")] * 200
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    docs = docs.select("*", *[F.lit(7).alias(c) for c in "term n p q i base block bucket place prefix ended docs total terms value rank part item".split()])
    for min_docs, options in ((3, {}), (5, {"block_sources": 2, "bucket_terms": 2, "top": 2}), (10**6, {})):
        got = divergence.audit(docs, min_docs=min_docs, **options).collect()
        assert sorted(map(tuple, got)) == plain_audit(rows, min_docs, options.get("top", 50))
    assert divergence.audit(docs.limit(0)).count() == 0


def test_prefixes_go_level_by_level(spark):
    """Terms longer than any first prefix, one of them the prefix of another, and a filter that lets all through."""
    rows = [("abcdefghij abcdefgh abcd abcdX1",), ("abcdefghij abcdefgh other",), ("abcdefghij",)]
    docs = spark.createDataFrame(rows, "text string").select(F.lit("en").cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))
    for bits in (64, 1 << 20):
        found = {r.term: r.docs for r in divergence.frequent_terms(docs, min_docs=2, first_bytes=2, bits=bits).collect()}
        assert found == {"abcdefghij": 3, "abcdefgh": 2}


def plain_repeats(rows, width):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None and first.get(key, i) >= i:
                first[key] = i
    out = []
    for i, w in texts:
        gone = {k + j for k in range(len(w) - width + 1) if i is not None and first[tuple(w[k : k + width])] < i for j in range(width)}
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_equal_plain(spark, seed):
    """Few words make a tangled graph; passages, copies and a hot text on top."""
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "longer-word-than-eight", "longer-word-than-eighT", "é"][: 3 + seed]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randrange(4, 30))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary + [f"u{rng.random()}"], k=rng.randrange(8))) for _ in range(rng.randrange(5))]
        rows.append((rng.randrange(-50, 10**9), rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows = list({i: (i, t) for i, t in rows}.values())
    rows += [(10**9 + i, rows[5][1]) for i in range(80)] + [(2**62, passages[0]), (-(2**62), passages[1]), (None, passages[2]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = debruijn.without_repeats(docs, width=5, run=2).collect()
    assert sorted(map(tuple, got), key=repr) == plain_repeats(rows, 5)


def test_words_are_named_by_all_their_bytes():
    import pyarrow as pa

    texts = [b"", b"one  two\x0b" + b"w" * 70 + b" " + b"w" * 71, b" \t", b"two one", b"one", "漢字 x é".encode(), b"12345678 123456789 12345678"]
    words = Words(pa.array(texts, pa.binary()).slice(0))
    split = [w for t in texts for w in t.split()]
    assert words.doc.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
    for lane in words.lane:
        names = lane.tolist()
        assert len(set(names)) == len(set(split)) and all((names[i] == names[j]) == (split[i] == split[j]) for i in range(len(split)) for j in range(i))
    part = Words(pa.array(texts, pa.binary()).slice(1, 3))
    assert [k for k, _ in groupby(part.doc.tolist())] == [0, 2] and part.lane[0].tolist() == words.lane[0].tolist()[: len(part.doc)]


def test_repeats_edges(spark):
    docs = edge_docs(spark)
    got = {(r.doc_id, r.n_words): r for r in debruijn.without_repeats(docs).collect()}
    assert len(got) == len({(r.doc_id, len((r.text or "").split())) for r in docs.collect()})
    n = len(LONG.split())
    assert got[6, n].n_removed == 0 and got[7, n].n_removed == n and got[7, n].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert debruijn.without_repeats(docs).count() == docs.count()
    assert debruijn.without_repeats(empty_docs(spark)).count() == 0


def test_passage_tasks_look_at_small_pieces():
    rng = random.Random(7)
    texts = [" ".join(str(rng.randrange(10)) for _ in range(100_000)).encode() for _ in range(16)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(16), pa.int64()), pa.array(texts, pa.binary())], names=["digest", "text"])
    out = list(debruijn._minimizer_rows(13, 6)(iter([batch])))
    assert len(out) >= 6 and {d for b in out for d in b.column(1).to_pylist()} == set(range(16))
