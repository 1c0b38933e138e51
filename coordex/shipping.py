"""Sends this package to the Python workers of a session."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file, once for each application; executors
    fetch it from the driver, so nothing has to be installed on them."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = Path(tempfile.mkdtemp(prefix="coordex-code-")) / "coordex.zip"
    path.write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _SENT.add(app)
