"""Random test data, made where it is used."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_strings(spark: SparkSession, rows: int, length: int = 10, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """id, key (of A-Z0-9), reproducible whatever the partitions: each character is
    a digit of a hash of the row, its place and the seed."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    base = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    chars = [F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(F.col("id"), F.lit(k), F.lit(seed)), F.lit(36)) + 1).cast("int"), F.lit(1)) for k in range(length)]
    return base.select("id", F.concat(*chars).alias("key"))


class RandomBytes(io.RawIOBase):
    """A read-only file of ``total`` random bytes that are made when read, in
    blocks that depend on the seed and their number alone."""

    BLOCK = 1 << 20

    def __init__(self, total: int, seed: int = 1):
        if total < 0:
            raise ValueError("total can't be negative")
        self.total, self.seed, self._at = total, seed, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def block_span(self, k: int) -> tuple[int, int]:
        """First byte and byte after the last of block k."""
        if not 0 <= k * self.BLOCK < max(self.total, 1):
            raise IndexError(f"no block {k}")
        return k * self.BLOCK, min((k + 1) * self.BLOCK, self.total)

    def block(self, k: int) -> bytes:
        low, high = self.block_span(k)
        return np.random.default_rng([self.seed, k]).bytes(self.BLOCK)[: high - low]

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0 if whence == io.SEEK_SET else self._at if whence == io.SEEK_CUR else self.total)
        if at < 0:
            raise ValueError("before the start")
        self._at = at
        return at

    def readinto(self, buffer) -> int:
        n = max(0, min(len(buffer), self.total - self._at))
        done = 0
        while done < n:
            k, inner = divmod(self._at, self.BLOCK)
            part = self.block(k)[inner : inner + n - done]
            buffer[done : done + len(part)] = part
            done += len(part)
            self._at += len(part)
        return n
