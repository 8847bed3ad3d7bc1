"""Images that arrive as files while a job runs.

Stateless: every new file is decoded and processed once; the source's own log of
seen files makes a restarted query go on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..options import PipelineOptions
from ..plans.pipeline import process_images
from ..sources.images import decode_files

_FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_images(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    found = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.png").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return decode_files(found)


def process_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, options: PipelineOptions | None = None, once: bool = True) -> StreamingQuery:
    """Results of all files that are there (``once``) or keep arriving, as Parquet in ``out``."""
    results = process_images(arriving_images(spark, folder), options)
    writer = results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
