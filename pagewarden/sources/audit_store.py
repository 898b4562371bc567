"""Stored audits on disk: five linked tables, written bucket by bucket.

A change writes the buckets it touches to a folder of its own and then publishes a new
version of the manifest, which says for each bucket in which folder it lies. Readers take
the newest version, so they see a change as a whole or not at all, and nothing that is
being read is overwritten. A version's file can be made only once: of two writers that
started from the same version one comes second, looks again, and publishes on top of the
other's version if that left its buckets alone, or else merges anew. A writer that dies
before it publishes leaves a folder that no version names, which ``vacuum`` removes.

Projects are dealt to buckets by linear hashing. Buckets split one after the other as the
store grows, so a bucket keeps about ``bucket_rows`` projects and a small change rewrites
a small part of the store, whatever its size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewarden.operators import store
from pagewarden.session import stored
from pagewarden.sources import folders

#: Version, number of buckets, and per table its schema and per bucket the folder it lies in; rows counts projects.
EMPTY = {"version": 0, "buckets": 0, "schemas": {}, "places": {}, "rows": {}}


class Conflict(Exception):
    """Other writers were faster on every attempt."""


def bucket_of(key: Column, buckets: int) -> Column:
    """Linear hashing: the lower half of the next power of two is split up to ``buckets``."""
    half = 1 << max(0, buckets.bit_length() - 1)
    h = F.xxhash64(key)
    wide = F.pmod(h, F.lit(2 * half).cast("bigint"))
    return F.when(wide < buckets, wide).otherwise(wide - half).cast("int")


def split_from(bucket: int) -> int:
    """The bucket whose rows a new one takes its share of."""
    return bucket - (1 << (bucket.bit_length() - 1)) if bucket else 0


class AuditStore:
    def __init__(self, spark: SparkSession, folder: str, bucket_rows: int = 2000, attempts: int = 20):
        self.spark, self.folder, self.bucket_rows, self.attempts = spark, folder.rstrip("/"), bucket_rows, attempts

    # files of the manifest -----------------------------------------------------------------

    def _path(self, *parts: str):
        return folders.path(self.spark, self.folder, *parts)

    def _files(self):
        return folders.files(self.spark, self.folder)

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in folders.names(self.spark, self.folder, "manifest") if n.startswith("v") and n.endswith(".json")]

    def _state(self, version: int | None = None) -> dict:
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return json.loads(json.dumps(EMPTY))
        file = f"{self.folder}/manifest/v{version:09d}.json"
        return json.loads(self.spark.read.text(file, wholetext=True).first().value)

    def _publish(self, state: dict) -> bool:
        """Make the file of a version, whole and only once: False if it is there."""
        draft, final = self._path("manifest", f"draft-{uuid.uuid4().hex}"), self._path("manifest", f"v{state['version']:09d}.json")
        out = self._files().create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, none)
            return True
        except Exception as error:
            self._files().delete(draft, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise

    # tables ---------------------------------------------------------------------------------

    def _read(self, state: dict, only: list[int] | None = None) -> dict[str, DataFrame]:
        """Tables of a version, with their ``bucket``; of the buckets ``only``, if given."""
        out = {}
        for name, schema in state["schemas"].items():
            at: dict[str, list[int]] = {}
            for bucket, folder in state["places"].items():
                if only is None or int(bucket) in only:
                    at.setdefault(folder, []).append(int(bucket))
            kind = T.StructType.fromJson(schema).add("bucket", T.IntegerType())
            if not at:
                out[name] = self.spark.createDataFrame([], kind)
                continue
            base = f"{self.folder}/{name}"
            kind.add("change", T.StringType())
            live = reduce(lambda a, b: a | b, [(F.col("change") == c) & F.col("bucket").isin(b) for c, b in at.items()])
            read = self.spark.read.schema(kind).option("basePath", base)
            out[name] = read.parquet(*[f"{base}/change={c}" for c in sorted(at)]).filter(live).drop("change")
        return out

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The five tables as they stand, or as a version left them; a store without commits has none."""
        return {n: t.drop("bucket") for n, t in self._read(self._state(version)).items()}

    def _change(self, keys: DataFrame, merge: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> None:
        """Replace the buckets of ``keys`` (project_id) by what ``merge`` makes of their rows."""
        keys = stored(keys.select("project_id").distinct(), "keys")
        incoming = keys.count()
        if not incoming:
            return
        for _ in range(self.attempts):
            state = self._state()
            buckets = state["buckets"] or max(1, -(-incoming // self.bucket_rows))
            touched = sorted(r.b for r in keys.select(bucket_of(F.col("project_id"), buckets).alias("b")).distinct().collect())
            # as many more buckets as the store wants, but no more than the change rewrites anyway
            want = -(-(sum(state["rows"].values()) + incoming) // self.bucket_rows)
            grown = max(buckets, min(want, buckets + len(touched))) if state["buckets"] else buckets
            old = sorted({*touched, *(split_from(b) for b in range(buckets, grown) if split_from(b) < buckets)})
            merged = merge(self._read(state, old))
            change = uuid.uuid4().hex
            for name, table in merged.items():
                # buckets lie together, so that the readers' filter skips row groups; large ones are split
                dealt = table.drop("bucket").withColumn("bucket", bucket_of(F.col("project_id"), grown))
                dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket").write.parquet(f"{self.folder}/{name}/change={change}")
            projects = self.spark.read.parquet(f"{self.folder}/projects/change={change}")
            rows = {str(r.bucket): r.n for r in projects.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
            written = {str(b): change for b in [*old, *range(buckets, grown)]}
            schemas = {n: T.StructType([f for f in t.schema.fields if f.name != "bucket"]).jsonValue() for n, t in merged.items()}
            while True:
                new = {
                    "version": state["version"] + 1, "buckets": grown, "schemas": state["schemas"] | schemas, "places": state["places"] | written,
                    "rows": {b: n for b, n in state["rows"].items() if b not in written} | rows,
                }
                if self._publish(new):
                    return
                now = self._state()
                same = now["buckets"] == state["buckets"] and all(now["places"].get(b) == state["places"].get(b) for b in written)
                if not same or now["schemas"] != state["schemas"]:
                    break
                state = now
        raise Conflict(f"{self.attempts} times another writer was faster")

    def upsert(self, audits: DataFrame) -> None:
        """Merge one wide audit per project: known projects keep id and ``created_at``, their
        children are replaced."""
        new = {n: t.drop("site_bucket") for n, t in store.split_audit(stored(audits, "audits")).items()}

        def merge(have: dict[str, DataFrame]) -> dict[str, DataFrame]:
            have = {n: t.drop("bucket") for n, t in have.items()}
            merged = {}
            for name, incoming in new.items():
                if name == "projects":
                    known = have.get(name, incoming.withColumn("created_at", F.col("updated_at")).limit(0))
                    merged[name] = store.upsert_projects(known, incoming)
                else:
                    merged[name] = store.replace_children(have[name], incoming) if name in have else incoming
            return merged

        self._change(new["projects"], merge)

    def delete(self, gone: DataFrame) -> None:
        """Remove the projects with the ids of ``gone`` from all five tables; an empty store stays as it is."""
        state = self._state()
        if not state["version"]:
            return
        keys = gone.select("project_id").distinct()
        found = self._read(state)["projects"].join(keys.hint("merge"), "project_id", "left_semi")
        self._change(found, lambda have: store.delete_projects({n: t.drop("bucket") for n, t in have.items()}, keys))

    def vacuum(self, keep: int = 1, started_before_ms: int | None = None) -> list[str]:
        """Remove what the last ``keep`` versions do not need: older versions, and the folders of
        changes that none of the kept ones names, published or not.

        A change that is still being written has a folder that no version names; only folders
        last modified before ``started_before_ms`` (default: a day ago) are taken for dead.
        """
        kept = self.versions()[-keep:]
        live = {c for v in kept for c in self._state(v)["places"].values()}
        limit = started_before_ms if started_before_ms is not None else self.spark._jvm.java.lang.System.currentTimeMillis() - 86_400_000
        files, removed = self._files(), []
        for version in self.versions():
            if version not in kept:
                files.delete(self._path("manifest", f"v{version:09d}.json"), False)
        for name in store.TABLES:
            for folder in folders.names(self.spark, self.folder, name):
                path = self._path(name, folder)
                if folder.startswith("change=") and folder[7:] not in live and files.getFileStatus(path).getModificationTime() < limit:
                    files.delete(path, True)
                    removed.append(f"{name}/{folder}")
        return removed
