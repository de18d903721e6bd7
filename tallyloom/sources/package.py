"""This package on the machines where Python workers run."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Python workers must import this package: where neither PYTHONPATH nor the working folder has it, Spark sends it to them."""
    root = Path(__file__).resolve().parents[2]
    known = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {Path.cwd()}
    app = spark.sparkContext.applicationId
    if root in known or app in _SHIPPED:
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp(prefix="tallyloom-package-")  # the driver serves it from here; executors fetch it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tallyloom", "zip", root, "tallyloom"))
