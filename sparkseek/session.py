"""Session construction and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sparkseek", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; keyword `conf` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    One of our own only where it is unset and the session runs on this machine
    alone; on a cluster a missing folder is an error, as no executor could read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = named or tempfile.mkdtemp(prefix="sparkseek-ckpt-", dir=os.environ.get("TMPDIR"))
        context.setCheckpointDir(folder)
        return folder
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and return it with a one-step lineage.

    Used where a plan is read several times or an iteration would grow without
    bound. The files survive the loss of an executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let_workers_import(spark: SparkSession) -> None:
    """Put this package's folder on the Python workers' path, for a checkout on a shared file system.

    A cluster without one gets the package through --py-files as usual.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
