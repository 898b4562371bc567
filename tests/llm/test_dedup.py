"""Exact and near duplicates against SQL and brute force."""

import random
import re
from collections import defaultdict

import duckdb

from pagewarden.llm import exact_dedup, lsh_forest
from pagewarden.llm.components import components
from pagewarden.llm.queries import ORACLES
from tests.llm.fixtures import LONG, edge_docs, empty_docs, sf, texts_of

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_exact_equals_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = con.execute(ORACLES["op6_exact_dedup"])
    names = [d[0] for d in want.description]
    got = exact_dedup.exact_duplicates(sf(spark, at="0.01")).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_exact_levels(spark):
    """Texts that part at every depth, copies among them, and one hot text."""
    texts = ["", " ", "a", "a ", "a  b\tc", "a b c", LONG, LONG + "x", LONG[:-1] + "x", LONG] + [LONG[:n] for n in (31, 32, 33, 255, 256, 257, 288, 289, 2335, 2336, 2337)] * 2 + ["hot text"] * 60
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[SPACE.sub(" ", t)].append(100 - i)
    want = {d: (min(g), len(g), d == min(g)) for g in groups.values() for d in g}
    for first, growth in ((32, 8), (1, 2), (4096, 8)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs, first_bytes=first, growth=growth).collect()}
        assert got == want


def test_exact_hot_groups_are_dealt(spark, monkeypatch):
    """Hot prefixes and hot copies give the same rows when they lie in many tasks."""
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 5)
    texts = [LONG[:40] + f" own {i}" for i in range(30)] + [LONG] * 25 + [LONG + " end"] * 3 + [f"alone {i}" for i in range(20)]
    docs = spark.createDataFrame([(i * 7 % 101, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t].append(i * 7 % 101)
    want = {d: (min(g), len(g), d == min(g)) for g in groups.values() for d in g}
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows} == want and len(rows) == len(texts)


def test_no_column_name_is_reserved(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y"), (2, "a", "z", "w")], "doc_id bigint, text string, _sha_of string, row string")
    assert [tuple(r) for r in exact_dedup.without_copies(docs).collect()] == [(1, "a", "x", "y")]
    assert exact_dedup.without_copies(docs.limit(0)).count() == 0


def test_one_of_each_stands_odd_rows(spark):
    """Repeated ids with the same text, null ids, and an empty table, as a stage of the pipeline meets them."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text + " more"), (None, text), (3, None), (4, "other words here")], "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in lsh_forest.one_of_each(docs).collect())
    assert kept == [1, 1, 3, 4] and lsh_forest.one_of_each(docs.limit(0)).count() == 0


def test_exact_edges(spark):
    docs = edge_docs(spark)
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == docs.count()
    repeated = [r for r in rows if r.doc_id == 3]
    assert sorted(r.kept for r in repeated) == [False, True] and {r.group_size for r in repeated} == {2}
    assert {r.keep_id for r in rows if r.doc_id in (0, 1)} == {0} and [r.kept for r in rows if r.doc_id is None] == [True]
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in rows)
    assert exact_dedup.exact_duplicates(empty_docs(spark)).count() == 0


def brute(rows, percent=85):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        sets[doc] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            having[x].append(d)
    for a, s in sets.items():
        for b in {b for x in s for b in having[x] if b < a}:
            common = len(s & sets[b])
            if 100 * common >= percent * (len(s) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def _near(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(docs, **options).collect()}


def test_near_equals_brute_force(spark):
    docs = sf(spark, at="0.01")
    assert _near(docs) == brute(texts_of(docs))


def test_family_around_one_text(spark):
    """Copies that are linked with their source and hardly with each other, far more than a region's pairs."""
    r = random.Random(4)
    word = lambda: f"v{r.randrange(10**6)}"
    rows, doc = [], 0
    for size in (150, 3):
        source = [word() for _ in range(300)]
        for k in range(size):
            copy = list(source)
            for _ in range(4 if k else 0):
                copy[r.randrange(300)] = word()
            rows.append((doc := doc + 1, " ".join(copy)))
    rows += [(1000 + i, " ".join(word() for _ in range(50))) for i in range(100)] + [(2000 + i, rows[3][1]) for i in range(40)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _near(docs, small=6) == brute(rows)


def test_inner_members_of_a_large_region(spark):
    """Rows too unlike to be linked that share a passage, and pairs among them: neither in small regions nor central."""
    r = random.Random(7)
    word = lambda: f"v{r.randrange(10**6)}"
    passage = [word() for _ in range(300)]
    rows = []
    for k in range(60):
        own = [word() for _ in range(50)]
        for i in (k, k + 60):
            tail = own[:-8] + [word() for _ in range(8)] if k % 2 else [word() for _ in range(50)]
            rows.append((i, " ".join(passage + tail)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert len({c for _, c, _ in want.values()}) == 90
    options = {"small": 2, "trees": 4, "depth": 1, "min_depth": 1, "slack": 0.85}
    assert _near(docs, **options) == want
    assert _near(docs, **options, cell_bytes=40_000) == want


def test_more_partitions_than_rows(spark):
    r = random.Random(3)
    base = [f"v{r.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(3)] + [(9, "quite another text of some words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        assert _near(docs) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_near_edges(spark):
    docs = edge_docs(spark)
    rows = lsh_forest.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [got[i].n_shingles for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 2] and all(got[i].component_id == i for i in (0, 1, 2, 3))
    assert got[5].component_id == 4 and got[7].component_id == 6 and not got[7].kept
    assert [r.kept for r in rows if r.doc_id is None] == [False]
    assert lsh_forest.near_duplicates(empty_docs(spark)).count() == 0
    assert lsh_forest.one_of_each(docs).columns[0] == "doc_id"


def test_components_of_a_long_path(spark):
    n = 40
    links = spark.createDataFrame([((i * 7) % n, ((i + 1) * 7) % n) for i in range(n - 1)] + [(100, 101)], "a bigint, b bigint")
    assert {r.node: r.component for r in components(links).collect()} == {i: 0 for i in range(n)} | {100: 100, 101: 100}
