"""Session defaults, shipping of the package to executors, and shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session this package opens itself; a session handed in is left as it is.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Bytes of one Arrow batch on its way to a Python worker.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def open_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with this package's defaults; keyword names use __ for dots."""
    builder = SparkSession.builder.appName("trawler")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so Python workers can import it.

    Batches for Python workers are bounded by bytes too, unless the session has a bound of its own: ten
    thousand rows of long texts are more than a worker should hold at once.
    """
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_trawler_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="trawler-"), "trawler_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    sc.addPyFile(target)
    sc._trawler_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, the warehouse, and in a local session, as in tests, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.split("[")[0] == "local"
        folder = f"file://{tempfile.gettempdir()}/trawler-shared" if local else spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder, which cut lineage and outlive lost executors; they go when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/trawler/{label}-{uuid.uuid4().hex}"
        self.count = 0
        target, files = self._place(self.base)
        files.deleteOnExit(target)

    def _place(self, path: str):
        """A Hadoop path and its file system."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, frame: DataFrame) -> DataFrame:
        """Write frame as Parquet and return it reread; the table's path is in .last."""
        self.count += 1
        self.last = f"{self.base}/{self.count}"
        frame.write.mode("overwrite").parquet(self.last)
        return self.spark.read.schema(frame.schema).parquet(self.last)

    def drop(self, path: str) -> None:
        """Delete one table that no later plan reads."""
        target, files = self._place(path)
        files.delete(target, True)
