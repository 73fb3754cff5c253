"""Progress of a scan: how many of its files are analysed, and the path of one of the last.

Tasks tell an accumulator of each file, whatever becomes of it; a thread of the driver looks at it and calls back. A file
that is analysed again, after an executor was lost, is told again, so the count is held to the total.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark import AccumulatorParam
from pyspark.sql import SparkSession


class _Seen(AccumulatorParam):
    def zero(self, value):
        return 0, None

    def addInPlace(self, a, b):
        return a[0] + b[0], b[1] if b[1] is not None else a[1]


class Progress:
    """with Progress(spark, callback) as progress: scan_path(..., progress=progress), and whatever runs the scan.

    callback(completed, total, path) is called when something is new, with completed never falling; at the end it has been
    called with all that was completed. What a callback raises ends the calls, and is raised at the end.
    """

    def __init__(self, spark: SparkSession, callback: Callable[[int, int, str | None], None], every: float = 0.2):
        self.seen, self.total = spark.sparkContext.accumulator((0, None), _Seen()), 0
        self.callback, self.every, self.told, self.error = callback, every, 0, None
        self._over = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def _tell(self) -> None:
        count, path = self.seen.value
        count = min(count, self.total) if self.total else count
        if count > self.told and self.error is None:
            self.told = count
            try:
                self.callback(count, max(self.total, count), path)
            except Exception as error:
                self.error = error

    def _watch(self) -> None:
        while not self._over.wait(self.every):
            self._tell()

    def __enter__(self) -> Progress:
        self._thread.start()
        return self

    def __exit__(self, kind, *_) -> None:
        self._over.set()
        self._thread.join()
        self._tell()
        if self.error is not None and kind is None:
            raise self.error
