"""Send this package to the executors, whose Python workers may not find it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Add the package's sources (some 100 KB) to an application's Python files, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="siltworks-code-")), "siltworks-code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.join("siltworks", os.path.relpath(full, top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
