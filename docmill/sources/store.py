"""Tables of one job in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset on a local master, as in tests, a temporary folder that goes with the process."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="docmill-store-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


class Store:
    """A folder of its own under the shared one. What is written there is read back as a table without lineage; remove() takes the folder away."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self._n = spark, f"{shared_folder(spark)}/docmill-store/{label}-{uuid.uuid4().hex[:12]}", 0
        self._held: dict[str, list[str]] = {}

    def write(self, df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
        """`df` as Parquet, in folders by a column if one is named, and read back. Packed by zstd: hashes and numbers take half the room that snappy leaves them."""
        self._n += 1
        at = f"{self.path}/{name}-{self._n}"
        self._held.setdefault(name, []).append(at)
        (df.write.partitionBy(by) if by else df.write).parquet(at, compression="zstd")
        return self.spark.read.schema(df.select(*[c for c in df.columns if c != by], *([by] if by else [])).schema).parquet(at)

    def forget(self, *names: str, keep: int = 0) -> None:
        """Take away the tables written under these names but the last `keep` of each; nothing may read them any more."""
        for name in names:
            held = self._held.get(name, [])
            self._held[name] = held[len(held) - keep :]
            for at in held[: len(held) - keep]:
                self._delete(at)

    def sweep(self) -> None:
        """Collect the driver's garbage: files of shuffles that no table refers to stay on the executors' disks until then."""
        self.spark._jvm.System.gc()

    def remove(self) -> None:
        self._delete(self.path)

    def _delete(self, at: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
