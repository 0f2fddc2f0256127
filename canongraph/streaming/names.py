"""Extension: graphs that arrive as files, named one micro-batch at a time.

A digest over sorted text cannot grow line by line, so each batch of complete files runs the batch plan. Graphs that cannot be
named leave a row with the message of their first error. See pieces.py for graphs that arrive in parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canongraph.plans.naming import outcomes
from canongraph.sources import gfa


def name_files(spark: SparkSession, folder: str, out: str, checkpoint: str, node_ids: str = "auto"):
    """Starts a query that names every GFA file put into ``folder`` and adds (graph_id, algorithm, digest, message) to ``out``, a folder for each batch."""
    stream = spark.readStream.option("lineSep", "\n").format("text").load(folder).select(F.col("_metadata.file_path").alias("graph_id"), "value")

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()  # the batch is read for segments, links and errors
        segments, links, errors = gfa.parse(rows)
        bad = errors.select("graph_id").distinct()
        good = lambda x: x.join(bad, "graph_id", "left_anti")
        found = outcomes(good(segments), good(links), node_ids, graphs=good(rows.select("graph_id").distinct()))
        failed = [r.graph_id for r in bad.unionByName(found.filter("message is not null").select("graph_id")).collect()]  # files of one batch
        if failed:  # only these are read again, with numbers to their lines
            none = F.lit(None).cast("string")
            said = gfa.first_errors(gfa.read_lines(spark, failed), node_ids == "integer")
            found = found.filter("message is null").unionByName(said.select("graph_id", none.alias("algorithm"), none.alias("digest"), "message"))
        # a batch has a folder of its own, so one that is tried again replaces what it wrote
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
