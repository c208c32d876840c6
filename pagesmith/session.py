"""Session helpers: a tuned local session, the size of a shuffle, shipping the package to workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, name: str = "pagesmith") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PAGESMITH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def width(spark: SparkSession) -> int:
    """Partitions for a stage of Python work: the session's shuffle width, which the operator of the cluster sets by the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once a session, so that a cluster needs no installation."""
    sc = spark.sparkContext
    if getattr(sc, "_pagesmith_shipped", False):
        return
    root = Path(__file__).resolve().parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    at = Path(tempfile.mkdtemp(prefix="pagesmith_")) / "pagesmith_pkg.zip"
    at.write_bytes(raw.getvalue())
    sc.addPyFile(str(at))
    sc._pagesmith_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Where it is unset a local session takes a folder of this machine; on a cluster that would be lost on other machines, so it is an error."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        have = tempfile.mkdtemp(prefix="pagesmith_ck_")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(have)
    return have
