"""Make the package importable in the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the workers once per application, as ``--py-files`` would.

    Needed where the cluster does not have the package installed; the scorer and
    the model fitting run functions of it inside tasks.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="signalspark-py-")) / "signalspark.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    return spark
