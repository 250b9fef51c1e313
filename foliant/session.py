"""Session helpers."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings for local runs and tests; a cluster's own settings win elsewhere.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    conf = LOCAL_CONF | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, once per application, through Spark's own file server."""
    sc = spark.sparkContext
    if getattr(sc, "_foliant_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    fd, name = tempfile.mkstemp(prefix="foliant-", suffix=".zip")
    with os.fdopen(fd, "wb") as f:
        f.write(packed.getvalue())
    sc.addPyFile(name)  # copied from the driver to each executor
    atexit.register(Path(name).unlink, missing_ok=True)
    sc._foliant_shipped = True
    return spark
