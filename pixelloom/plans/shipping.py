"""Sends this package to the Python workers, so that clusters need no installation of it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        root = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp()) / f"{root.name}_core.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, str(path.relative_to(root.parent)))
        context.addPyFile(str(archive))
        _SENT.add(context.applicationId)
