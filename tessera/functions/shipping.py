"""Gets the package to Python workers that could not import it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the application's Python files.

    Only in one local process, whose workers share the driver's folder and PYTHONPATH, may it be left out: executors of a
    cluster have neither.
    """
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    local = master == "local" or master.startswith("local[")
    if app in _SHIPPED or local and (ROOT in paths or Path.cwd().resolve() == ROOT):
        return
    archive = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((ROOT / "tessera").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
