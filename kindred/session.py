"""A session with the settings the library's plans expect."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "kindred", master: str | None = None, **conf: str) -> SparkSession:
    """A SparkSession: adaptive execution with skew joins and coalescing, UTC. ``conf`` keys take '__' for '.'."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share, spark.checkpoint.dir; a local session without one gets a
    folder of its own. What is there stays until the caller removes it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kindred-")
    return f"{folder.rstrip('/')}/kindred-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python, once for each context, unless PYTHONPATH already leads them to it."""
    package = Path(__file__).resolve().parent
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if str(package.parent) in paths or getattr(context, "_kindred_shipped", False):
        return
    target = f"{tempfile.mkdtemp(prefix='kindred-')}/kindred.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(target)
    context._kindred_shipped = True
