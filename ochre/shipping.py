"""Sends this package to the executors, for the few operators that run Python there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent_to: set[str] = set()


def ensure_shipped(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.applicationId in _sent_to:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ochre-core-")) / "ochre-core.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _sent_to.add(context.applicationId)
