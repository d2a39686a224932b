"""Findings of pages as they arrive: the batch operators on Structured Streaming tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gleanspark.operators import pages
from gleanspark.sources import html

PAGES = "page_id long, url string, html string"


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Pages of the Parquet files in a folder, and of those that come later, so many files at a time."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def findings(arriving_pages: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """The metadata analyzers' findings of each page: no state, so a page's findings come with its own batch."""
    return pages.metadata_findings(html.parsed(arriving_pages), enabled)


def write(found: DataFrame, target: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """Append findings to Parquet, each page once whatever restarts: the checkpoint says which files are done.

    available_now: end when what is there now has been read.
    """
    to = found.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
    return (to.trigger(availableNow=True) if available_now else to).start()
