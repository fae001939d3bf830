"""Session helpers: a local session with the settings the library is written for, and shipping of the code."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that the plans count on; a cluster's own values for sizes stay as they are.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    b = SparkSession.builder.master(master).appName("casework")
    for k, v in (CONF | {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers, wherever the executors run; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_casework_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="casework-")) / "casework.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(to))
    sc._casework_shipped = True
    return spark
