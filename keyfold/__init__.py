"""keyfold: keyed-aggregation jobs as PySpark DataFrames."""

from keyfold.config import JobConfig
from keyfold.operators.aggregates import Measure, keyed_aggregate
from keyfold.plans.job import Job

__all__ = ["Job", "JobConfig", "Measure", "keyed_aggregate"]
