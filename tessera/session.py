"""What any job of this package needs from its Spark session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    home = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(path)
    sc._tessera_shipped = True
