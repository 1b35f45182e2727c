"""A Spark-native batch engine: jobs of staged operators as one lazy plan."""

from .operators import Collect, Exchange, Filter, Groupby, Operation, Reduce, Sample, Scan, Sort, Transform, Write
from .plans import Job, Result
from .session import get_session

__all__ = ["Collect", "Exchange", "Filter", "Groupby", "Job", "Operation", "Reduce", "Result", "Sample", "Scan", "Sort", "Transform", "Write", "get_session"]
