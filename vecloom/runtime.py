"""Session plumbing shared by all operators: code shipping, scratch tables, sizing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
FORGET_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once for each application.

    The archive is handed to Spark's own file server, so no executor needs the checkout.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    place = Path(tempfile.mkdtemp(prefix="vecloom-code-"))
    atexit.register(shutil.rmtree, place, True)
    archive = place / "vecloom-code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Where it is unset, a local master (tests) gets a temporary folder that goes at exit; any other
    master uses a folder below the warehouse, which a cluster shares by definition.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        base = tempfile.mkdtemp(prefix="vecloom-scratch-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", f"file://{base}")
        return f"file://{base}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/vecloom-scratch"


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it; what its making shuffled is deleted at once, since the table stands for it now."""
        before = self.spark.conf.get(FORGET_SHUFFLES, None)
        self.spark.conf.set(FORGET_SHUFFLES, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            if before is None:
                self.spark.conf.unset(FORGET_SHUFFLES)
            else:
                self.spark.conf.set(FORGET_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no returned plan reads any more, or all of them without names."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in [self.path(n) for n in names] or [self.root]:
            hp = jvm.org.apache.hadoop.fs.Path(p)
            hp.getFileSystem(conf).delete(hp, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path may be on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repo_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
