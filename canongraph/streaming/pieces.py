"""Extension: graphs that arrive line by line, in any order and over any number of batches, named when they are complete.

Rows are (graph_id, line_no, value); the row with a null value ends a graph, and its line_no says how many lines there are. Keyed state
holds a graph's lines until all of them are there; lines that come again (as sources may send them) count once. A graph that gets no
line for ``timeout_ms`` is given up: its state goes, and its row says how far it came. Nothing is named on half its lines.

Complete graphs leave the state within one batch and take the batch plan; each batch replaces its own folder, so a query that is
started again after a failure, from its checkpoint, gives every graph one result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from canongraph.plans.naming import outcomes
from canongraph.sources import gfa

OUT = "graph_id string, line_no long, value string, message string"


class Gather(StatefulProcessor):
    """Lines of a graph until it is complete."""

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms  # None: no timers

    def init(self, handle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "line_no long, value string")
        self.known = handle.getValueState("known", "rows long, expected long, timer long")

    def handleInputRows(self, key, rows, timerValues):
        came, expected = [], None
        for r in rows:
            if r.value is None:
                expected = r.line_no
            else:
                came.append((r.line_no, r.value))
        if came:
            self.lines.appendList(came)
        before = self.known.get() if self.known.exists() else (0, None, None)
        count, expected = before[0] + len(came), before[1] if expected is None else expected
        if before[2] is not None:
            self.handle.deleteTimer(before[2])
        if expected is not None and count >= expected:
            whole = dict(self.lines.get()) if count else {}
            if all(i in whole for i in range(1, expected + 1)):
                self._forget()
                yield Row(graph_id=key[0], line_no=None, value=None, message=None)  # a graph may have no lines
                for i in range(1, expected + 1):
                    yield Row(graph_id=key[0], line_no=i, value=whole[i], message=None)
                return
        timer = None
        if self.timeout_ms is not None:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(timer)
        self.known.update((count, expected, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        count, expected, _ = self.known.get()
        distinct = len({x[0] for x in self.lines.get()}) if count else 0
        self._forget()
        yield Row(graph_id=key[0], line_no=None, value=None, message=f"Graph is incomplete: {distinct} of {'an unknown number of' if expected is None else expected} lines")

    def _forget(self) -> None:
        self.lines.clear()
        self.known.clear()

    def close(self) -> None:
        pass


def named(rows: DataFrame, node_ids: str = "auto") -> DataFrame:
    """(graph_id, algorithm, digest, message) of the graphs whose lines a batch completes, or that it gives up."""
    lost = rows.filter("message is not null").select("graph_id", F.lit(None).cast("string").alias("algorithm"), F.lit(None).cast("string").alias("digest"), "message")
    lines = rows.filter("line_no is not null").select("graph_id", "line_no", "value")
    segments, links, errors = gfa.parse(lines)
    wrong = errors.select("graph_id").distinct()
    good = lambda t: t.join(wrong, "graph_id", "left_anti")
    whole = rows.filter("message is null").select("graph_id").distinct()
    found = outcomes(good(segments), good(links), node_ids, graphs=good(whole))
    # a message from a text is that of its first wrong line
    failed = wrong.unionByName(found.filter("message is not null").select("graph_id"))
    said = gfa.first_errors(lines.join(failed, "graph_id", "left_semi"), node_ids == "integer")
    none = F.lit(None).cast("string")
    return found.filter("message is null").unionByName(said.select("graph_id", none.alias("algorithm"), none.alias("digest"), "message")).unionByName(lost)


def name_pieces(stream: DataFrame, out: str, checkpoint: str, node_ids: str = "auto", timeout_ms: int = 600_000, once: bool = True):
    """Starts a query over a stream of (graph_id, line_no, value) that adds outcomes of graphs to ``out``, a folder for each batch.

    ``once``: what is there now, then stop; graphs that are not complete wait in the state for the next run. Else it runs until
    it is stopped, and only then graphs are given up. The state is kept in RocksDB, beside the checkpoint.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select(F.col("graph_id").cast("string").alias("graph_id"), F.col("line_no").cast("long").alias("line_no"), F.col("value").cast("string").alias("value"))
    # with timers Spark runs batches for ever, so a run that is to end has none
    gather, mode = (Gather(None), "None") if once else (Gather(timeout_ms), "ProcessingTime")
    complete = rows.groupBy("graph_id").transformWithState(gather, OUT, "Append", mode)

    def batch(done: DataFrame, number: int) -> None:
        done = done.persist()
        named(done, node_ids).write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.unpersist()

    writer = complete.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
