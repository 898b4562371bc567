"""Mergeable counts of a stream's batches, compacted level by level.

Each batch leaves the counts of its own rows. When ``fan`` parts of one level are complete
they become one part of the next, so after n batches a reader opens at most ``fan`` parts
on each of log n levels, and a count is rewritten once per level. A part is named by the
batches that it covers, and counts only where a larger one does not cover it: a merge that
dies leaves its inputs in force, and a batch that runs again replaces or repeats itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewarden.sources import folders


class Partials:
    """``merge`` sums counts that may repeat a key; it must give the columns that it takes."""

    def __init__(self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame], fan: int = 8):
        self.spark, self.folder, self.merge, self.fan = spark, folder.rstrip("/"), merge, fan

    def _complete(self) -> list[tuple[int, int]]:
        """(first, last) batch of every part whose writing has ended."""
        found = []
        for name in folders.names(self.spark, self.folder):
            first, _, last = name.partition("-")
            if first.isdigit() and last.isdigit() and "_SUCCESS" in folders.names(self.spark, self.folder, name):
                found.append((int(first), int(last)))
        return found

    def parts(self) -> list[tuple[int, int]]:
        """The parts in force: complete ones that no larger one covers."""
        found = sorted(self._complete(), key=lambda p: (p[0], -p[1]))
        out: list[tuple[int, int]] = []
        for first, last in found:
            if not out or last > out[-1][1]:
                out.append((first, last))
        return out

    def _place(self, part: tuple[int, int]) -> str:
        return f"{self.folder}/{part[0]:012d}-{part[1]:012d}"

    def _read(self, some: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(self._place(some[0])).schema).parquet(*[self._place(p) for p in some])

    def add(self, batch: int, counts: DataFrame) -> None:
        """The counts of a batch, in place of what an earlier run of it has left."""
        if any(first <= batch <= last and first < last for first, last in self.parts()):
            return  # merged already: the batch had ended when it was
        counts.write.mode("overwrite").parquet(self._place((batch, batch)))
        width = self.fan
        while (batch + 1) % width == 0:
            whole = (batch + 1 - width, batch)
            inputs = [p for p in self.parts() if whole[0] <= p[0] and p[1] <= whole[1]]
            if len(inputs) < 2:
                break
            self.merge(self._read(inputs)).write.mode("overwrite").parquet(self._place(whole))
            width *= self.fan
        self._drop_covered(batch)

    def _drop_covered(self, batch: int) -> None:
        """Remove parts that a larger one has covered for some batches: who reads them is done by then."""
        live = self.parts()
        for part in self._complete():
            if part not in live and part[1] < batch - 2 * self.fan:
                folders.delete(self.spark, self._place(part))

    def read(self) -> DataFrame:
        """The merged counts of all batches so far."""
        return self.merge(self._read(self.parts()))
