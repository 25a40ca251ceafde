"""Getting this package to executors that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession, root: str) -> bool:
    """Sends the package and the modules beside it in ``root`` to all workers of the session, unless they look there anyway; whether it did."""
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.path.realpath(os.getcwd()) == os.path.realpath(root) or spark.sparkContext.applicationId in _sent:
        return False
    path = os.path.join(tempfile.mkdtemp(prefix="assay-"), "sparkassay.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "sparkassay")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
        for name in sorted(os.listdir(root)):
            if name.endswith(".py"):
                z.write(os.path.join(root, name), name)
    spark.sparkContext.addPyFile(path)
    _sent.add(spark.sparkContext.applicationId)
    return True
