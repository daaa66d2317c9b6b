"""Results of range queries kept by step: a query asked again evaluates only the steps that are not there yet."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prom import PromEngine


class RangeCache:
    """query_range over an engine, with the points of settled steps in a folder of the store.

    Steps of one query and width that lie on the same grid share an entry, a run of steps without gaps. Steps newer than
    ``lag_ms`` before ``now_ms`` may still change: they are evaluated and not kept. A query that names the start or the
    end of its range is not kept at all, and a request apart from what is there replaces nothing.
    """

    def __init__(self, engine: PromEngine, path: str, lag_ms: int = 300_000):
        self.engine, self.spark, self.path, self.lag = engine, engine.spark, path, lag_ms

    def _entry(self, query: str, start: int, step: int) -> str:
        return f"{self.path}/{hashlib.sha256(f'{query} {step} {start % step}'.encode()).hexdigest()[:32]}"

    def _there(self, entry: str) -> tuple[int, int] | None:
        """The first and last step of an entry."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{entry}/covered")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return tuple(self.spark.read.parquet(f"{entry}/covered").agg(F.min("first"), F.max("last")).first())

    def query_range(self, query: str, start_ms: int, end_ms: int, step_ms: int, now_ms: int) -> DataFrame:
        end_ms = start_ms + (end_ms - start_ms) // step_ms * step_ms
        if re.search(r"@\s*(start|end)\s*\(", query):
            return self.engine.query_range(query, start_ms, end_ms, step_ms)
        entry = self._entry(query, start_ms, step_ms)
        settled = start_ms + (min(end_ms, now_ms - self.lag) - start_ms) // step_ms * step_ms
        there = self._there(entry)
        if settled >= start_ms and (there is None or start_ms <= there[1] + step_ms and settled >= there[0] - step_ms):
            missing = [(start_ms, settled)] if there is None else [(start_ms, there[0] - step_ms), (there[1] + step_ms, settled)]
            for first, last in missing:
                if first <= last:
                    self.engine.query_range(query, first, last, step_ms).write.mode("append").parquet(f"{entry}/points")
                    self.spark.createDataFrame([(first, last)], "first long, last long").write.mode("append").parquet(f"{entry}/covered")
            there = self._there(entry)
        else:
            settled = start_ms - step_ms  # nothing of it is kept
        out = None
        if settled >= start_ms:
            schema = "labels map<string,string>, step_ms long, value double"
            out = self.spark.read.schema(schema).parquet(f"{entry}/points").where(F.col("step_ms").between(start_ms, settled))
        if settled < end_ms:
            fresh = self.engine.query_range(query, settled + step_ms, end_ms, step_ms).select("labels", "step_ms", "value")
            out = fresh if out is None else out.unionByName(fresh)
        return out
