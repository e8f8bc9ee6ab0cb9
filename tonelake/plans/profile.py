"""How long queries and triggers take: mean and largest time of every N runs, as rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROFILE = "name string, runs int, rows long, mean_us long, max_us long"


def profiled(name: str, df: DataFrame, runs: int = 10) -> DataFrame:
    """(name, runs, rows, mean_us, max_us) of a query run ``runs`` times to its last row, its result thrown away.

    Rows are counted while they pass, by an observation; a run whose count differs from the first raises. Each run plans
    anew, so that none reads what another shuffled.
    """
    spark, took, rows = df.sparkSession, [], None
    for _ in range(runs):
        seen = Observation()
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        began = time.perf_counter_ns()
        watched.write.format("noop").mode("overwrite").save()
        took.append((time.perf_counter_ns() - began) // 1000)
        if rows not in (None, seen.get["rows"]):
            raise ValueError(f"{name}: {seen.get['rows']} rows after {rows}")
        rows = seen.get["rows"]
    return spark.createDataFrame([(name, runs, rows, sum(took) // runs, max(took))], PROFILE)


class TriggerProfile(StreamingQueryListener):
    """Collects the time of every trigger that had rows; a line of figures each ``every`` of them, by query name or id."""

    def __init__(self, every: int = 10) -> None:
        self.every, self.open, self.lines = every, {}, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.add(p.name or str(p.id), int(p.numInputRows), 1000 * int(p.batchDuration))

    def add(self, name: str, rows: int, us: int) -> None:
        own = self.open.setdefault(name, [])
        own.append((rows, us))
        if len(own) == self.every:
            self.lines.append((name, len(own), sum(r for r, _ in own), sum(u for _, u in own) // len(own), max(u for _, u in own)))
            self.open[name] = []

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, runs, rows, mean_us, max_us) so far, whole groups only."""
        return spark.createDataFrame(self.lines, PROFILE)
