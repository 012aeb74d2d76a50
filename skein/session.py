"""A session with the settings that the engine relies on."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "skein", **conf: str) -> SparkSession:
    """UTC time, adaptive plans with skew handling; further settings by name (dots as __)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each Spark context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_skein_shipped", None) is None:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-skein-')}/skein", "zip", root.parent, root.name)
        context.addPyFile(archive)
        context._skein_shipped = archive
    return spark
