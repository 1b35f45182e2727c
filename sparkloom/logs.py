"""Logging of the engine."""

from __future__ import annotations

import logging
import sys
from typing import TextIO

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def setup_logger(level: int | str = logging.INFO, format: str = FORMAT, stream: TextIO | None = None, filename: str | None = None) -> logging.Logger:
    """The engine's logger, writing to a file or a stream (standard error by default).
    A second call replaces the first one's handler."""
    logger = logging.getLogger("sparkloom")
    logger.setLevel(level.upper() if isinstance(level, str) else level)
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    handler = logging.FileHandler(filename) if filename else logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(logging.Formatter(format))
    logger.addHandler(handler)
    logger.propagate = False
    return logger
