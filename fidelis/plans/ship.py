"""Send the package to executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session once, unless PYTHONPATH names their folder already."""
    if _ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.sparkContext.applicationId in _SENT:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="fidelis-"), "fidelis.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "fidelis")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(path)
    _SENT.add(spark.sparkContext.applicationId)
