"""Makes this package importable on executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once a session, as --py-files would, unless PYTHONPATH already leads to it."""
    top = Path(__file__).resolve().parent
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if top.parent in paths or app in _SHIPPED:
        return
    folder = tempfile.mkdtemp()  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    bundle = Path(folder, f"{top.name}.zip")
    with zipfile.ZipFile(bundle, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(bundle))
    _SHIPPED.add(app)
