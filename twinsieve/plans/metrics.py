"""Counts and times of a run's stages, taken while the stages run.

A stage's rows are counted by an observation that rides on the job which writes them, so no second
pass counts them; what is written is what the next stage reads.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..session import workspace

SCHEMA = "stage string, seconds double, n_in long, n_out long, reduction_pct double, throughput double, pct_of_total double, bottleneck boolean, more string"

#: Lets Spark delete a job's shuffles when it ends. A stage is written, so nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass
class Metrics:
    spark: SparkSession
    slow: float = 5.0
    stages: list[dict] = field(default_factory=list)
    places: dict[str, str] = field(default_factory=dict)

    def run(self, name: str, df: DataFrame, after: tuple[str, ...] = (), **more: Column) -> DataFrame:
        """df written in the shared folder and read again. after: the stages whose rows it takes in. more: further aggregates of its rows."""
        seen = Observation(name)
        at = f"{workspace(self.spark, 'stages')}"
        began = time.time()
        held = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.observe(seen, F.count(F.lit(1)).alias("n_out"), *[c.alias(k) for k, c in more.items()]).write.option("compression", "zstd").parquet(at)
        finally:
            self.spark.conf.set(CLEANUP, held)
        took = time.time() - began
        got, self.places[name] = dict(seen.get), at
        known = {s["stage"]: s["n_out"] for s in self.stages}
        self.stages.append({"stage": name, "seconds": took, "n_in": sum(known[a] for a in after) if after else got["n_out"], "n_out": got.pop("n_out"), "more": json.dumps(got, default=str)})
        return self.spark.read.schema(df.schema).parquet(at)

    def forget(self, *names: str) -> None:
        """Deletes the rows of stages that no later one reads, so that they don't fill the disk beside its own; what was counted stays."""
        for name in names:
            if name in self.places:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.places.pop(name))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def total(self) -> float:
        return sum(s["seconds"] for s in self.stages)

    def table(self) -> DataFrame:
        """A row for each stage, in order: seconds, rows in and out, what part was dropped, rows out a second, and whether it is a bottleneck."""
        total = max(self.total(), 1e-3)
        rows = [
            (s["stage"], s["seconds"], s["n_in"], s["n_out"], 100.0 * (1 - s["n_out"] / max(s["n_in"], 1)), s["n_out"] / max(s["seconds"], 1e-3), 100.0 * s["seconds"] / total, s["seconds"] >= self.slow, s["more"]) for s in self.stages
        ]
        return self.spark.createDataFrame(rows, SCHEMA)

    def bottlenecks(self) -> DataFrame:
        return self.table().where("bottleneck").orderBy(F.desc("seconds"))

    def save(self, path: str) -> None:
        self.table().coalesce(1).write.mode("overwrite").json(path)
