"""Cycles of steps whose tables become visible together, by one marker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Step = tuple[str, Callable[["Cycles", str], DataFrame]]


class Cycles:
    """Tables `root/NAME/cycle=KEY`, and a marker `root/_done/KEY` for each cycle that has ended.

    A cycle writes its tables one after the other, each whole, into folders of its own and makes its marker last. Readers look
    only at cycles with a marker, so a cycle that broke off shows nothing; the next run of its key writes its tables anew.
    Running a cycle that has its marker does nothing, which makes the marker the gate as well. Keys are ordered as text: an
    older key than the newest finished one is refused, because it would have to change what later cycles have read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def finished(self) -> list[str]:
        """Keys of the finished cycles, oldest first."""
        fs, at = self._at(f"{self.root}/_done")
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def staged(self, name: str, key: str) -> DataFrame:
        """A table of the cycle that is running, for its later steps."""
        return self.spark.read.parquet(f"{self.root}/{name}/cycle={key}")

    def table(self, name: str, before: str | None = None) -> DataFrame | None:
        """A table of the newest finished cycle (older than `before`), or None."""
        keys = [k for k in self.finished() if before is None or k < before]
        return self.staged(name, keys[-1]) if keys else None

    def run(self, key: str, steps: list[Step]) -> bool:
        """Runs the steps of a cycle and makes its marker; False if it had one already."""
        done = self.finished()
        if key in done:
            return False
        if done and key < done[-1]:
            raise ValueError(f"cycle {key} is older than {done[-1]}, which has finished")
        for name, make in steps:
            make(self, key).write.mode("overwrite").parquet(f"{self.root}/{name}/cycle={key}")
        fs, at = self._at(f"{self.root}/_done/{key}")
        fs.create(at, False).close()        # fails if another run of this cycle was faster
        return True
