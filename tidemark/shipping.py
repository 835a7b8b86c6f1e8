"""Send this package to the executors, so that Python functions find it wherever the driver was started."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    at = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    at.write_bytes(data.getvalue())
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)
