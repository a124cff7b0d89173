"""Sends this package to the executors' Python where it isn't on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application; nothing to do where PYTHONPATH or the working folder has the package."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    known = [Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if root in known or context.applicationId in _sent:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="chronomill-"), "chronomill.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "chronomill").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(target)
    _sent.add(context.applicationId)
