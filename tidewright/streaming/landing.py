"""Keep landing the page documents that arrive in a folder.

The reference work is batch only; this is the same landing step, run by a file
stream: each page becomes a batch with its source and ledger rows, so that it can
be profiled and loaded like any other. A micro-batch that is retried finds its
pages landed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewright.plans import onboarding
from tidewright.session import reliable
from tidewright.sources import pages


def land_pages(spark: SparkSession, ws: onboarding.Workspace, folder: str, tenant_id: str, source_name: str, checkpoint: str, kind: str = "crm") -> StreamingQuery:
    """Start the stream; it ends when all files present have been landed."""
    documents = spark.readStream.format("text").load(folder).select("value", F.col("_metadata.file_path").alias("path"))
    parsed = pages.parse_pages(documents, "value", ["path"])

    def land(batch: DataFrame, _: int) -> None:
        rows = reliable(pages.page_items(batch, ["path"]))
        if not rows.isEmpty():
            onboarding.land_pages(ws, rows, tenant_id, source_name, kind)

    return parsed.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
