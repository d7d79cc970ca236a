"""This package for Python workers, wherever the driver was started."""

from __future__ import annotations

import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per application."""
    app, home = spark.sparkContext.applicationId, Path(__file__).resolve().parents[1]
    with _SHIPPING:  # tasks are fitted side by side
        if app not in _SHIPPED and home.is_dir():
            place = Path(tempfile.mkdtemp(prefix="yearloom-"), f"{home.name}_package.zip")
            with zipfile.ZipFile(place, "w") as archive:
                for source in sorted(home.rglob("*.py")):
                    archive.write(source, source.relative_to(home.parent))
            spark.sparkContext.addPyFile(str(place))
        _SHIPPED.add(app)
