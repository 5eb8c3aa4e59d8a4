"""A Spark session with the engine's defaults."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package where only the driver's path has it."""
    env = spark.sparkContext.environment
    held = env.get("PYTHONPATH", "")
    if ROOT not in os.pathsep.join([held, os.environ.get("PYTHONPATH", "")]).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in [held, ROOT] if x)


#: Rows of a few plain columns that are broadcast at most.
FEW = 1_000_000


def beside(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, broadcast to what joins it where it has few rows: then many pairs needn't be shuffled by each of their ends."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def workspace(spark: SparkSession, label: str) -> str:
    """A new place for an operator's own tables in the folder that driver and executors share, deleted when the application ends.

    That folder is spark.checkpoint.dir; without one, only local masters get a place, in the warehouse.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and spark.sparkContext.master.startswith("local"):
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if not at:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = f"{at.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def session(name: str = "twinsieve", master: str | None = None, **conf: str) -> SparkSession:
    """AQE with skew handling, UTC. Partition counts follow the data at run time; conf overrides anything."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    return builder.config(map=defaults | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
