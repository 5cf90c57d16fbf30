"""Session set-up."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "spark.lexispark.shipped"


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": memory, "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName("lexispark").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once in a session, so that their Python workers can import it."""
    if spark.conf.get(_SHIPPED, None):
        return
    root = Path(__file__).resolve().parent
    # A name of its own: the driver's file server hands the archive out, executors never read this path themselves.
    archive = os.path.join(tempfile.mkdtemp(prefix="lexispark-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set(_SHIPPED, "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all of Spark
    is one process (tests); on a cluster that raises, as a folder of one machine would lose data."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^,\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexispark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in shared_dir()."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
