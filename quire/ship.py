"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to the workers through Spark's own file server, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix=f"{here.name}-", suffix=".zip")
    with os.fdopen(fd, "wb") as raw, zipfile.ZipFile(raw, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent))
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)
