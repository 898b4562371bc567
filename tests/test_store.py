"""The audit store: changes that die, writers that meet, buckets that split, folders that go."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from pagewarden.operators import store
from pagewarden.sources.audit_store import AuditStore, Conflict, bucket_of, split_from

SCHEMA = "url string, seo_score int, updated_at timestamp, findings string, pages string"


def _audits(spark, rows):
    return spark.createDataFrame([(f"https://{u}.com", s, dt.datetime(2026, 1, d), f"f{s}", f"p{s}") for u, s, d in rows], SCHEMA)


def _new(spark, **options):
    return AuditStore(spark, tempfile.mkdtemp(prefix="pagewarden-") + "/store", **options)


def _state(kept):
    """Scores by site, after a look at every child."""
    tables = kept.tables()
    scores = {r.url[8:-4]: r.seo_score for r in tables["projects"].collect()}
    for name, column, letter in (("audit_results", "findings", "f"), ("crawl_data", "pages", "p")):
        children = tables[name].join(tables["projects"].select("project_id", "url"), "project_id").collect()
        assert sorted((r.url[8:-4], r[column]) for r in children) == sorted((u, f"{letter}{s}") for u, s in scores.items())
    return scores


def test_empty_store(spark):
    kept = _new(spark)
    assert kept.tables() == {} and kept.versions() == [] and kept.vacuum() == []
    kept.delete(spark.createDataFrame([("x",)], "project_id string"))
    kept.upsert(_audits(spark, []))
    assert kept.tables() == {} and kept.versions() == []


@pytest.mark.parametrize("after", ["first table", "all tables"])
def test_a_change_that_died_leaves_no_trace(spark, after, monkeypatch):
    kept = _new(spark)
    kept.upsert(_audits(spark, [("a", 1, 1), ("b", 2, 1)]))
    with monkeypatch.context() as m:
        if after == "all tables":
            m.setattr(AuditStore, "_publish", lambda self, state: 1 / 0)
        else:
            m.setattr(store, "replace_children", lambda old, new: old.select(F.raise_error("lost")))
        with pytest.raises(Exception):  # noqa: B017
            kept.upsert(_audits(spark, [("a", 9, 2), ("c", 3, 2)]))
    assert _state(kept) == {"a": 1, "b": 2}
    kept.upsert(_audits(spark, [("b", 20, 2), ("c", 3, 2)]))
    assert _state(kept) == {"a": 1, "b": 20, "c": 3}
    later = spark._jvm.java.lang.System.currentTimeMillis() + 60_000
    gone = kept.vacuum(started_before_ms=later)
    assert any(g.startswith("projects/") for g in gone) and kept.vacuum(started_before_ms=later) == []
    assert _state(kept) == {"a": 1, "b": 20, "c": 3} and kept.versions() == [2]


class Meeting(AuditStore):
    """A store whose next change finds another writer's change published just before its own."""

    others: list

    def _publish(self, state):
        if self.others:
            self.others.pop(0)()
        return super()._publish(state)


@pytest.mark.parametrize("rows", [1, 2000])
def test_two_writers(spark, rows):
    """With a bucket for every project the other's buckets are not ours; with one bucket they are."""
    first = _new(spark, bucket_rows=rows)
    first.upsert(_audits(spark, [(f"s{i}", i, 1) for i in range(12)]))
    mine = Meeting(spark, first.folder, bucket_rows=rows)
    mine.others = [lambda: first.upsert(_audits(spark, [("s1", 100, 2)])), lambda: first.delete(first.tables()["projects"].filter("url = 'https://s2.com'"))]
    mine.upsert(_audits(spark, [("s3", 300, 3), ("new", 7, 3)]))
    want = {f"s{i}": i for i in range(12)} | {"s1": 100, "s3": 300, "new": 7}
    del want["s2"]
    assert _state(first) == _state(mine) == want and len(first.versions()) == 4


def test_a_writer_gives_up_after_its_attempts(spark):
    first = _new(spark)
    first.upsert(_audits(spark, [("a", 1, 1)]))
    mine = Meeting(spark, first.folder, attempts=2)
    mine.others = [lambda k=k: first.upsert(_audits(spark, [("a", k, 2)])) for k in (5, 6, 7)]
    with pytest.raises(Conflict):
        mine.upsert(_audits(spark, [("a", 99, 3)]))
    assert _state(first) == {"a": 6}


def test_buckets_split_with_the_store(spark):
    kept = _new(spark, bucket_rows=4)
    want = {}
    for day, n in enumerate((8, 20, 30), 1):
        rows = [(f"d{day}x{i}", 100 * day + i, day) for i in range(n)]
        kept.upsert(_audits(spark, rows))
        want |= {u: s for u, s, _ in rows}
    assert _state(kept) == want
    state = kept._state()
    assert state["buckets"] == 8 and sum(state["rows"].values()) == 58  # 2, and then at most twice as many with each change
    before = state["places"]
    kept.upsert(_audits(spark, [("d1x0", 5, 9)]))
    after = kept._state()["places"]
    moved = [b for b in after if before.get(b) != after[b]]
    assert len(moved) <= 3 and _state(kept) == want | {"d1x0": 5}  # its bucket, and a split one with its source
    assert _state_of_version(kept, 3) == want


def _state_of_version(kept, version):
    return {r.url[8:-4]: r.seo_score for r in kept.tables(version)["projects"].collect()}


def test_linear_hashing_moves_rows_only_to_the_new_bucket(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("k"))
    for n in range(1, 20):
        for r in rows.select(bucket_of(F.col("k"), n).alias("old"), bucket_of(F.col("k"), n + 1).alias("new")).distinct().collect():
            assert 0 <= r.old < n and (r.new == r.old or (r.new == n and r.old == split_from(n)))


def test_ids_of_a_change_do_not_pass_the_driver(spark):
    from pagewarden.operators import store

    have = spark.createDataFrame([("a", 1), ("b", 2)], "project_id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "project_id string, v int")
    replaced = store.replace_children(have, new)
    left = store.delete_projects({"t": have}, new)["t"]
    assert sorted(map(tuple, replaced.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert [tuple(r) for r in left.collect()] == [("a", 1)]
    for df in (replaced, left):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
