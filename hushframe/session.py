"""Sessions: settings, and the package on the executors."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings a session should have; the caller's own win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName("hushframe").config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``. One of fewer files than there are cores would keep as few cores busy,
    so its rows are dealt to all of them; a table of more files is read as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that its functions can be
    imported there even if the cluster does not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_hushframe_shipped", False):
        return
    here, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, path.relative_to(here.parent))
    target = Path(tempfile.mkdtemp(prefix="hushframe-")) / "hushframe.zip"
    target.write_bytes(data.getvalue())
    context.addPyFile(str(target))
    context._hushframe_shipped = True
