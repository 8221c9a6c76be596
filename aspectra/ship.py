"""Make this package importable for the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Send the package to the session's workers, once an application, so that no node needs it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="aspectra-")) / "aspectra_package.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(home.rglob("*.py")):
            out.write(p, p.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
