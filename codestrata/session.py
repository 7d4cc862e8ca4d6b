"""Session helpers: table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`.

    Only a local master may go without that setting; it then gets a temporary folder, which is deleted when the program ends.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor shares")
        own = tempfile.mkdtemp(prefix="codestrata-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = "file://" + own
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_ROOTS: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this program's operators have written to the shared folder. Frames they returned can no longer be read, so results must be stored first."""
    while _ROOTS:
        _delete(spark, _ROOTS.pop())


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder, to cut lineage so that a lost executor costs no recomputation. `clear_scratch` deletes them all."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _ROOTS.append(self.root)

    def path(self, label: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{label}-{self._n}"

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table written by `write` that no later plan reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(self.spark, path)

    def let_go(self) -> None:
        """Have the driver collect its garbage, so that the shuffle files of finished steps are deleted now and not some time later."""
        gc.collect()
        self.spark._jvm.System.gc()
