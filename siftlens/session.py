"""Session settings the engine expects, and how its code reaches the executors."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Bytes of a batch between the JVM and Python, where the session does not say.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def session(app: str = "siftlens", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Give the package's modules to the executors of this application, once: Python functions of the engine are
    imported there by name. Batches for them are bounded by bytes, as texts may be long."""
    if not spark.sparkContext.getConf().contains(BATCH_BYTES[0]):
        spark.conf.set(*BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="siftlens-code-")) / "siftlens_code.zip"
        with zipfile.ZipFile(to, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(to))
        _shipped.add(app)
    return spark
