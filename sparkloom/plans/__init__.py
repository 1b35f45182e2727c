"""Jobs, and sizing of their exchanges."""

from .job import Job, Result
from .planner import approx_rows, shuffle_seconds, stage_seconds, worker_count

__all__ = ["Job", "Result", "approx_rows", "shuffle_seconds", "stage_seconds", "worker_count"]
