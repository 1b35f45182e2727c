"""Key samples for range bounds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.partitioning import segment_bounds
from .base import Operation


class Sample(Operation):
    """About ``fraction`` of the key's values that aren't missing. Range exchanges
    take their own samples; this one is for bounds outside of them.

    With ``by``, columns that tell rows apart, a row is taken where the first 28 bits
    of md5(their values joined by ``|``, the seed last) lie in the fraction: the same
    rows whatever the partitions, and in any engine. Without it the sample is seeded
    per partition."""

    def __init__(self, key: str, fraction: float = 0.01, seed: int = 17, by: list[str] | None = None):
        if not 0 < fraction <= 1:
            raise ValueError("fraction must be in (0, 1]")
        self.key, self.fraction, self.seed, self.by = key, fraction, seed, by

    def run(self, df: DataFrame) -> DataFrame:
        present = df.filter(F.col(self.key).isNotNull())
        if self.fraction == 1:
            return present.select(self.key)
        if self.by is None:
            return present.select(self.key).sample(fraction=self.fraction, seed=self.seed)
        digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in self.by], F.lit(str(self.seed))).cast("binary"))
        place = F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")
        return present.filter(place < math.ceil(self.fraction * (1 << 28))).select(self.key)

    def bounds(self, df: DataFrame, segments: int) -> list:
        """segments - 1 quantiles of the sample."""
        return segment_bounds(self.run(df), self.key, segments)

    def explain(self) -> str:
        return f"Sample ({self.key})"
