"""Jobs of stages of operators, composed into one lazy plan per sink."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.checks import partition_counts
from ..operators import Collect, Exchange, Groupby, Operation, Reduce, Sample, Scan, Sort, Write


@dataclass
class Result:
    """What a job returns: its last stage's plan, and rows, a path or row counts;
    ``sinks`` has the same of every stage that ends the job, by number."""

    df: DataFrame
    rows: pd.DataFrame | None = None
    path: str | None = None
    counts: dict[int, int] = field(default_factory=dict)
    sinks: dict[int, Result] = field(default_factory=dict)


class Job:
    """Stages with ordered operators, and dependencies between them.

    ``add`` takes an operator or its class with arguments; stages that don't
    exist yet are made. Any number of stages in any order of declaration; a stage
    without a parent begins with a ``Scan``, and a cycle or a second parent fails."""

    def __init__(self, num_stages: int | None = None):
        self.stages: dict[int, list[Operation]] = {k: [] for k in range(num_stages or 0)}
        self.dependencies: list[tuple[int, int]] = []

    def add(self, stage: int, op: Operation | type[Operation], **kwargs: Any) -> Job:
        self.stages.setdefault(stage, []).append(op(**kwargs) if isinstance(op, type) else op)
        return self

    def dependency(self, parent: int, child: int) -> Job:
        for s in (parent, child):
            if s not in self.stages:
                raise ValueError(f"no stage {s}")
        if any(c == child and p != parent for p, c in self.dependencies):
            raise ValueError(f"stage {child} has a parent already")
        self.dependencies.append((parent, child))
        return self

    def order(self) -> list[int]:
        """Stages with parents before children."""
        parent = {c: p for p, c in self.dependencies}
        done: list[int] = []
        waiting = [s for s in self.stages if self.stages[s]]
        while waiting:
            ready = [s for s in waiting if s not in parent or parent[s] in done]
            if not ready:
                raise ValueError("the stages depend on each other in a cycle")
            done += ready
            waiting = [s for s in waiting if s not in ready]
        return done

    def _deciding(self, stage: int, columns: list[str] | None = None) -> Operation | None:
        """The last Sort or Groupby of a stage's children; of those, where ``columns``
        are given, whose key the stage's rows have already."""
        found = [op for p, c in self.dependencies if p == stage for op in self.stages[c] if isinstance(op, Sort | Groupby)]
        here = [op for op in found if columns is None or op.key in columns]
        return (here or found or [None])[-1]

    def _combining(self, stage: int, by: Operation | None) -> Reduce | None:
        """The opaque Reduce with a combine that is all a stage's exchange serves: first
        operator behind the deciding Groupby, itself the first of the only child."""
        children = [self.stages[c] for p, c in self.dependencies if p == stage]
        if isinstance(by, Groupby) and len(children) == 1 and len(ops := children[0]) > 1 and ops[0] is by and isinstance(ops[1], Reduce) and ops[1].combine is not None:
            return ops[1]
        return None

    def plan(self, spark: SparkSession) -> dict[int, DataFrame]:
        """Each stage's lazy result."""
        parent = {c: p for p, c in self.dependencies}
        out: dict[int, DataFrame] = {}
        ranged: dict[int, Operation | None] = {}  # what decided an exchange of n partitions
        combined: dict[int, Reduce | None] = {}  # whose partial rows an exchange dealt
        for s in self.order():
            ops = self.stages[s]
            if s in parent:
                out[s] = self._apply(ops, out[parent[s]], ranged.get(parent[s]), combined.get(parent[s]))
            else:
                if not ops[0].is_source:
                    raise ValueError(f"stage {s} has neither a parent nor a source")
                out[s] = self._apply(ops[1:], ops[0].read(spark))
            if isinstance(ops[-1], Exchange):
                by = self._deciding(s, out[s].columns)
                ranged[s] = by if ops[-1].fixed else None
                combined[s] = self._combining(s, by)
                if combined[s] is not None:
                    out[s] = combined[s].partial(out[s])
                if not self._left_to_catalyst(s, by):
                    out[s] = ops[-1].deal(out[s], by)
        return out

    def _left_to_catalyst(self, stage: int, by: Operation | None) -> bool:
        """Declarative sorts and aggregates without a fixed number of partitions
        need no exchange of ours: Catalyst adds one, behind partial sums."""
        exchange = self.stages[stage][-1]
        if exchange.fixed or by is None:
            return False
        if isinstance(by, Sort):
            return True
        ops = next(self.stages[c] for p, c in self.dependencies if p == stage and by in self.stages[c])
        after = ops[ops.index(by) + 1 :]
        return bool(after) and isinstance(after[0], Reduce) and after[0].declarative

    def _apply(self, ops: list[Operation], df: DataFrame, ranged: Operation | None = None, combined: Reduce | None = None) -> DataFrame:
        """``ranged``: the operator by whose key an exchange of n partitions dealt the
        rows; ``combined``: the Reduce whose partial rows they are."""
        key, moved = None, False
        for k, op in enumerate(ops):
            if isinstance(op, Scan):
                raise ValueError("a source must be the first operator of a stage without a parent")
            if isinstance(op, Exchange | Collect | Write):
                if k != len(ops) - 1:
                    raise ValueError(f"{type(op).__name__} must be the last operator of its stage")
            elif isinstance(op, Groupby):
                key = op.key
            elif isinstance(op, Sort):
                df, moved = (op.run_in_partitions(df), moved) if op is ranged and not moved else (op.run(df), True)
            elif isinstance(op, Reduce) and op.declarative:
                df, key, moved = op.aggregate(df, key), None, True
            elif op is combined:
                df = op.whole(df)
            else:
                df = op.run(df)
        return df

    def _source(self, stage: int) -> str | None:
        """Path of the scan that a stage's rows come from."""
        parent = {c: p for p, c in self.dependencies}
        while stage in parent:
            stage = parent[stage]
        return getattr(self.stages[stage][0], "path", None)

    def run(self, spark: SparkSession) -> Result:
        """Runs the sink of every stage that ends the job; without a sink, counts the
        rows of each partition. The result is that of the last one."""
        frames = self.plan(spark)
        parents = {p for p, _ in self.dependencies}
        ends = [s for s in self.order() if s not in parents]
        sinks: dict[int, Result] = {}
        for s in ends:
            last, df = self.stages[s][-1], frames[s]
            if isinstance(last, Collect):
                sinks[s] = Result(df, rows=last.collect(df))
            elif isinstance(last, Write):
                sinks[s] = Result(df, path=last.write(df, self._source(s)))
            else:
                sinks[s] = Result(df, counts={r.partition: r.rows for r in partition_counts(df).collect()})
        if not sinks:
            raise ValueError("the job has no stages")
        result = sinks[ends[-1]]
        return Result(result.df, result.rows, result.path, result.counts, sinks)

    def explain(self, spark: SparkSession | None = None) -> str:
        """The stages as text, any time; with a session, the physical plans too."""
        lines = []
        for s in self.order():
            if isinstance(self.stages[s][-1], Exchange) and isinstance(by := self._deciding(s), Sort):
                lines.append(f"prep: {Sample(by.key).explain()}")
            lines.append(f"Stage {s}:")
            lines += [f"\t· {op.explain()}" for op in self.stages[s]]
        if spark is not None:
            for s, df in self.plan(spark).items():
                lines += [f"Plan {s}:", df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))]
        return "\n".join(lines)
