"""A log of what streams did, from the engine's own reports of their progress and end."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "run_id string, state string, batches long, input_rows long, error string"


class RunLog(StreamingQueryListener):
    """Collects a stream's batches, rows and end state by its run; a few numbers a run."""

    def __init__(self) -> None:
        self.runs: dict[str, dict] = {}

    def _run(self, run_id) -> dict:
        return self.runs.setdefault(str(run_id), {"state": "running", "batches": set(), "rows": {}, "error": None})

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._run(event.runId)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        run, progress = self._run(event.progress.runId), event.progress
        run["batches"].add(progress.batchId)
        run["rows"][progress.batchId] = max(run["rows"].get(progress.batchId, 0), progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        run = self._run(event.runId)
        run["state"], run["error"] = ("failed", str(event.exception)) if event.exception else ("finished", None)

    def rows(self) -> list[tuple]:
        return [(run_id, r["state"], len(r["batches"]), sum(r["rows"].values()), r["error"]) for run_id, r in sorted(self.runs.items())]


def logged(spark: SparkSession, work: Callable[[], None], path: str, patience: float = 30.0) -> DataFrame:
    """Do ``work``, which runs streams, and append a row for each run that ended to the log at ``path``; give the log.

    A run that fails is logged before its error goes on. The engine reports ends a
    moment after they happen: ``patience`` is how many seconds they may take.
    """
    log, error = RunLog(), None
    spark.streams.addListener(log)
    try:
        try:
            work()
        except Exception as e:  # kept until the run is in the log
            error = e
        until = time.time() + patience
        while (not log.runs or any(r["state"] == "running" for r in log.runs.values())) and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    spark.createDataFrame(log.rows(), SCHEMA).coalesce(1).write.mode("append").parquet(path)
    if error:
        raise error
    return spark.read.schema(SCHEMA).parquet(path)
