"""Session and shared-folder helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}
_SCRATCH: dict[str, list[str]] = {}


def local_session(cores: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("glasra")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    The archive is served by the driver, so no folder has to be shared for it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="glasra-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of spark.checkpoint.dir. A local session without one gets a folder of its own, which
    goes when Python ends; on a cluster there has to be one, as a folder of one machine would lose data.
    """
    set_one = spark.conf.get("spark.checkpoint.dir", None)
    if set_one:
        return set_one.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = path = tempfile.mkdtemp(prefix="glasra-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return _OWN[sc.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; `clean` takes away those of this application."""
    path = f"{shared_folder(spark)}/glasra-{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Delete the scratch folders of this application, once the frames that read them are no longer needed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the folder that all executors share.

    The session deletes a copy when nothing refers to it, if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
