"""Session helpers: sending the package to executors that do not have it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the executors' Python path, once for each application.

    Needed where Python functions of the package run on executors that were started without it.
    """
    if getattr(spark.sparkContext, "_quarry_shipped", False):
        return
    top = str(_ROOT.parent)
    if top not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        folder = tempfile.mkdtemp(prefix="quarry-ship-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/quarry", "zip", top, _ROOT.name))
    spark.sparkContext._quarry_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as written to the shared folder that ``spark.checkpoint.dir`` names; a folder of our own only where it is unset."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quarry-"))
    return df.checkpoint()


def settings() -> dict[str, str]:
    """Settings the engine is built for; a cluster's own values win."""
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
