"""A job: a map step, keyed aggregates, HAVING and ORDER BY over some inputs."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from keyfold.config import JobConfig
from keyfold.operators.aggregates import Measure, keyed_aggregate
from keyfold.operators.partition import two_stage_aggregate
from keyfold.sources.readers import read_lines, read_whole_files

Frames = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Job:
    """``mapper`` turns the input rows into rows with the key columns and what the measures read.

    Everything is declared, so that filters and column choice reach the scan. A mapper that needs
    opaque Python code per batch can call ``mapInArrow`` or ``mapInPandas`` itself.
    """

    keys: Sequence[str]
    measures: Sequence[Measure]
    mapper: Frames = field(default=lambda df: df)
    having: Column | str | Frames | None = None
    sort: Sequence[Column | str] | Frames | None = None
    config: JobConfig = JobConfig()

    def validate(self) -> Job:
        """Raises on a job that can't run."""
        if not self.measures:
            raise ValueError("a job needs a measure")
        names = [*self.keys, *(m.name for m in self.measures)]
        if len(set(names)) < len(names):
            raise ValueError(f"output names repeat: {names}")
        for name in ("mapper", "having", "sort"):
            if callable(f := getattr(self, name)) and not isinstance(f, Column) and len(inspect.signature(f).parameters) != 1:
                raise TypeError(f"{name} takes one DataFrame")
        return self

    def read(self, spark: SparkSession) -> DataFrame:
        """The configured inputs as one relation: lines, or whole files without logical splits."""
        if not self.config.inputs:
            raise ValueError("the job has no inputs")
        if self.config.split_bytes:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(self.config.split_bytes))
        return (read_lines if self.config.logical_split else read_whole_files)(spark, *self.config.inputs)

    def apply(self, rows: DataFrame) -> DataFrame:
        """The job's result over given rows."""
        self.validate()
        c = self.config
        mapped = self.mapper(rows)
        if c.randomized_partition:
            out = two_stage_aggregate(mapped, self.keys, self.measures, c.salts, drop_empty=c.drop_empty)
        else:
            out = keyed_aggregate(mapped, self.keys, self.measures, c.drop_empty)
        if self.having is not None:
            out = self.having(out) if callable(self.having) and not isinstance(self.having, Column) else out.filter(self.having)
        if c.num_reducers:
            out = out.repartition(c.num_reducers, *self.keys) if self.keys else out.coalesce(1)
        if self.sort is not None:
            out = self.sort(out) if callable(self.sort) else out.sortWithinPartitions(*self.sort) if c.num_reducers and self.keys and not c.randomized_partition else out.orderBy(*self.sort)
        return out

    def run(self, spark: SparkSession) -> DataFrame:
        """The job's result over its inputs; Spark logs at the configured level from here on."""
        spark.sparkContext.setLogLevel(self.config.spark_log_level)
        return self.apply(self.read(spark))

    def explain(self, spark: SparkSession) -> str:
        """The physical plan as text."""
        df = self.run(spark)
        return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def track(spark: SparkSession) -> dict[str, int]:
    """Tasks of the stages that run just now."""
    seen = spark.sparkContext.statusTracker()
    infos = [i for i in map(seen.getStageInfo, seen.getActiveStageIds()) if i]
    return {"stages": len(infos), "tasks": sum(i.numTasks for i in infos), "active": sum(i.numActiveTasks for i in infos), "completed": sum(i.numCompletedTasks for i in infos), "failed": sum(i.numFailedTasks for i in infos)}
