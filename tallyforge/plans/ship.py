"""Send this package to the executors' Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the running application, once for each."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        root = Path(__file__).resolve().parents[2]
        with tempfile.TemporaryDirectory() as at:
            copy = Path(at, "src")
            shutil.copytree(root / "tallyforge", copy / "tallyforge", ignore=shutil.ignore_patterns("__pycache__"))
            made = shutil.make_archive(str(Path(tempfile.mkdtemp(), "tallyforge-package")), "zip", copy)
        spark.sparkContext.addPyFile(made)
        _sent.add(app)
