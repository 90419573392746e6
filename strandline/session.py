"""Session settings that the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for a local session; a cluster's own settings win.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", memory)
    for k, v in LOCAL.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, wherever they run and whatever their path; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_strandline_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "strandline.zip"  # read by the driver's file server only
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(archive))
    sc._strandline_shipped = True


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder named by ``spark.checkpoint.dir``.

    Where that setting is missing, which only a local session may do, a folder
    of this machine is used.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return df.checkpoint()
