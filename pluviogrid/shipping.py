"""Sends this package to the executors, so that Python workers can import it wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE = "_pluviogrid_shipped"


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the context, once."""
    sc = spark.sparkContext
    if getattr(sc, _DONE, False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="pluviogrid-"), "pluviogrid_sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(path)
    setattr(sc, _DONE, True)
