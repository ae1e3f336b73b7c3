"""Progress of streaming queries as a table: a listener writes each batch's figures as they come, by query and batch."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tallyrank.sources.commits import CommitLog

EVENTS = "query string, run string, batch long, state string, rows long, rows_per_second double, millis long, error string"
#: The batch under which a query's end stands.
END = 1 << 40


class ProgressTable(StreamingQueryListener):
    """Writes one small file a batch under ``path``/<query id>, and one more when the query ends. A batch that is told twice is written once:
    its number is the file's name. Add it with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _put(self, query, run, batch, **event) -> None:
        log = CommitLog(self.spark, f"{self.path}/{query}")
        number = END if batch is None else int(batch)
        if number == END or number not in log.numbers():
            log.append(number, {"query": str(query), "run": str(run), "batch": batch, **event}, again=number == END)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows or p.batchDuration:
            self._put(p.id, p.runId, p.batchId, state="running", rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond, millis=p.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._put(event.id, event.runId, None, state="error" if event.exception else "done", error=event.exception)


def progress_rows(spark: SparkSession, path: str, query: str | None = None) -> DataFrame:
    """EVENTS of all queries, or of one: rows with a batch, and one with the state where the query has ended."""
    rows = spark.read.schema(EVENTS).option("recursiveFileLookup", True).json(path)
    return rows if query is None else rows.filter(F.col("query") == query)


def state_of(spark: SparkSession, path: str, query: str) -> dict:
    """What a user is told of a query: batches, rows so far, and whether it runs, is done or has failed."""
    row = progress_rows(spark, path, query).agg(F.count("batch").alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max(F.when(F.col("batch").isNull(), F.col("state"))).alias("state"), F.max("error").alias("error")).first()
    return {"batches": row["batches"], "rows": row["rows"], "status": row["state"] or "running", "error_message": row["error"]}


def until_told(spark: SparkSession, path: str, query: str, most: float = 60.0) -> None:
    """Waits until a query's end is in the table: listeners are told some time after it."""
    end = time.monotonic() + most
    log = CommitLog(spark, f"{path}/{query}")
    while END not in log.numbers():
        if time.monotonic() > end:
            raise TimeoutError(f"the end of {query} was not told")
        time.sleep(0.1)
