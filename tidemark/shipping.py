"""What functions and tables of this package need on a cluster: the package on every worker, a folder that all share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per application; Spark's own file server spreads the archive."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    to = tempfile.mkdtemp(prefix="tidemark-ship-")  # on the driver; served from there as long as it runs
    atexit.register(shutil.rmtree, to, True)
    with tempfile.TemporaryDirectory() as d:
        shutil.copytree(package, Path(d) / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{to}/{package.name}-{sc.applicationId}", "zip", d))
    sc._tidemark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder set on the context.

    Only where both are missing and the master is local, a temporary folder is set; on a cluster that is an error, as every
    executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        top = sc.getCheckpointDir()
    return top.rstrip("/")
