"""A session with the settings the engine is made for, and the package on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Static size of a shuffle on a laptop; adaptive execution coalesces it. On a cluster set it to two or three times the cores.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
}
HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make the package importable on the executors.

    Nothing is sent where ``PYTHONPATH`` names its folder already.  Elsewhere the
    sources are zipped once a session, and the driver serves the file.
    """
    context = spark.sparkContext
    if str(HERE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_curaloom_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="curaloom-")) / "curaloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(HERE.rglob("*.py")):
            z.write(source, source.relative_to(HERE.parent))
    context.addPyFile(str(path))
    context._curaloom_shipped = True


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("curaloom")
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    spark = (builder.master(master) if master else builder).getOrCreate()
    ship(spark)
    return spark
