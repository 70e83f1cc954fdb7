"""Log events as JSON lines, and timed samples as rows for ``evaluate.latency_summary``."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SAMPLE = "key string, seq long, ms double"
_logger = logging.getLogger("gristmill")


def log_event(event: str, **fields) -> str:
    """One JSON line to the log ``gristmill``: the event, then its fields by name; what JSON lacks is written as text."""
    line = json.dumps({"event": event, **dict(sorted(fields.items()))}, ensure_ascii=False, default=str)
    _logger.info(line)
    return line


class Timings:
    """Timed samples of one driver, by key, the last ``kept`` of each."""

    def __init__(self, kept: int = 512):
        self.kept, self.n, self.samples = kept, 0, {}

    @contextmanager
    def timed(self, key: str) -> Iterator[None]:
        """Times what is inside, also when it fails."""
        began = time.perf_counter()
        try:
            yield
        finally:
            own = self.samples.setdefault(key, [])
            own.append((key, self.n, (time.perf_counter() - began) * 1000))
            self.n += 1
            del own[: -self.kept]

    def rows(self, spark: SparkSession) -> DataFrame:
        """(key, seq, ms)."""
        return spark.createDataFrame([x for own in self.samples.values() for x in own], SAMPLE)
