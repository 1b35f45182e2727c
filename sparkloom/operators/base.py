"""The protocol of operators: a lazy step from one DataFrame to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame


class Operation:
    """A no-op; operators override ``run`` and, where useful, ``explain``."""

    #: Whether the operator makes rows instead of changing those it gets.
    is_source = False

    def run(self, df: DataFrame) -> DataFrame:
        return df

    def explain(self) -> str:
        return type(self).__name__
