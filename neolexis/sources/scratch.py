"""Tables written to the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PARTITIONS = "spark.sql.shuffle.partitions"
_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local master (as in tests) gets a temporary folder; a cluster, none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "own" not in _roots:
        _roots["own"] = tempfile.mkdtemp(prefix="neolexis-")
        spark.sparkContext.setCheckpointDir(_roots["own"])
    return "file://" + _roots["own"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/neolexis-{uuid.uuid4().hex}/{name}"
    atexit.register(_quietly_remove, spark, path.rsplit("/", 1)[0])
    return path


def _quietly_remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone by then
        pass


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables in the shared folder."""

    def __init__(self, spark: SparkSession, pieces: int = 0):
        """pieces: the least number of shuffle partitions while a table is written."""
        self.spark, self.pieces = spark, pieces
        self.paths: list[str] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back. What its plan shuffled is of no use any more and goes at once."""
        path = scratch_path(self.spark, name)
        conf = self.spark.conf
        before, dealt = conf.get(_CLEANUP, "false"), conf.get(_PARTITIONS)
        conf.set(_CLEANUP, "true")
        conf.set(_PARTITIONS, str(max(self.pieces, int(dealt))))
        try:
            df.write.parquet(path)
        finally:
            conf.set(_CLEANUP, before)
            conf.set(_PARTITIONS, dealt)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path.rsplit("/", 1)[0]
        self.paths.append(out._scratch)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        path = getattr(df, "_scratch", None)
        if path in self.paths:
            self.paths.remove(path)
            remove(self.spark, path)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all saved tables but these."""
        for path in set(self.paths) - {t._scratch for t in tables}:
            self.paths.remove(path)
            remove(self.spark, path)
