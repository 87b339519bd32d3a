"""Session defaults, table access and the shared checkpoint folder."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for the engine's own sessions. On a cluster the submitter's values win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.ui.enabled": "false",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quaystone")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory} | conf
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once, so that none needs it installed or on its path."""
    context = spark.sparkContext
    if getattr(context, "_quaystone_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quaystone-code-")) / "quaystone.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    context._quaystone_shipped = True


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a data folder: a parquet file or a folder of them."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share for checkpoints.

    Taken from ``spark.checkpoint.dir``. Only a ``local[...]`` master, where
    everything is one process, gets a folder of this machine when none is set.
    """
    context = spark.sparkContext
    at = context.getCheckpointDir()
    if at:
        return at
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quaystone-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(at)
    return context.getCheckpointDir() or at


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that later stages do not recompute it and a lost executor costs nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_once(acts: Iterable[Callable[[], object]]) -> None:
    """Run writes that do not depend on each other side by side; the first error is raised when all have ended."""
    acts = list(acts)
    with ThreadPoolExecutor(max(len(acts), 1)) as pool:
        running = [pool.submit(act) for act in acts]
    for one in running:
        one.result()


#: Folders of applications that are there and go when their JVM ends.
_OWN: set[str] = set()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application below the shared checkpoint folder; all of them are deleted when the application ends."""
    own = f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    if own not in _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _OWN.add(own)
    return f"{own}/{name}"


def state_of(spark: SparkSession, base: str, name: str) -> str:
    """What the files of a table are now (names, sizes, times): the same as long as nobody writes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    told = sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in found)
    return hashlib.sha256("\n".join([base, name, *told]).encode()).hexdigest()[:24]
