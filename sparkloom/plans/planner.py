"""Cost model of an all-to-all exchange through object storage (the Locus
equations; Pu et al., NSDI 2019), as an optional way to choose partitions. By
default adaptive execution sizes exchanges at run time."""

from __future__ import annotations

import math
from dataclasses import dataclass

MIB = 1 << 20
# Fixed values of the cost model: bytes read at once, a worker's memory, the least and
# the most of it that data may use, the fewest and the most workers looked at.
CHUNK = 64 * MIB
WORKER_BYTES = 2048 * MIB
LEAST_USE, MOST_USE = 0.05, 0.5
FEWEST, MOST = 3, 1000


@dataclass(frozen=True)
class Rates:
    """Bytes a second of one worker, and requests a second of the store in all."""

    read_bandwidth: float
    write_bandwidth: float
    read_requests: float
    write_requests: float


def _pass_seconds(size: float, workers: int, bandwidth: float, objects: float, requests: float) -> float:
    return max(size / (bandwidth * workers), objects / requests)


def shuffle_seconds(size: float, workers: int, rates: Rates, chunk: int = CHUNK) -> float:
    """Write and read of a shuffle: each worker has an object for each other."""
    objects = math.ceil(size / (chunk * workers**2)) * workers**2
    return _pass_seconds(size, workers, rates.write_bandwidth, objects, rates.write_requests) + _pass_seconds(size, workers, rates.read_bandwidth, objects, rates.read_requests)


def stage_seconds(size: float, workers: int, rates: Rates, chunk: int = CHUNK) -> float:
    """The same with reading the input and writing the output."""
    objects = math.ceil(size / (chunk * workers)) * workers
    return _pass_seconds(size, workers, rates.read_bandwidth, objects, rates.read_requests) + shuffle_seconds(size, workers, rates, chunk) + _pass_seconds(size, workers, rates.write_bandwidth, objects, rates.write_requests)


def worker_count(size: float, rates: Rates, worker_bytes: int = WORKER_BYTES, least_use: float = LEAST_USE, most_use: float = MOST_USE, at_most: int = MOST) -> int:
    """The cheapest number of workers whose share of the data fits between the
    memory bounds; the fewest on a tie. Above what ``at_most`` workers hold within
    the upper bound, the number that fits is returned all the same."""
    low = max(int(size / (worker_bytes * most_use)), FEWEST)
    high = max(min(int(size / (worker_bytes * least_use)), at_most), low)
    return min(range(low, high + 1), key=lambda p: (shuffle_seconds(size, p, rates), p))


def approx_rows(total_bytes: int, part_bytes: int, part_rows: int) -> int:
    """Rows of a file by the mean row of a part of it; 0 for no rows."""
    if part_rows <= 0 or part_bytes < part_rows:
        return 0
    return total_bytes // (part_bytes // part_rows)
