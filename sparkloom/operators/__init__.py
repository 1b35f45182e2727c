"""Operators of a job's stages."""

from .base import Operation
from .collect import Collect, Write
from .exchange import Exchange, Groupby, Sort
from .pandas_partition import whole_partition
from .rows import Filter, Reduce, Transform
from .sample import Sample
from .scan import Scan

__all__ = ["Collect", "Exchange", "Filter", "Groupby", "Operation", "Reduce", "Sample", "Scan", "Sort", "Transform", "Write", "whole_partition"]
