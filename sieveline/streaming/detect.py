"""Detection on streams: candidates of one file do not depend on others, so the batch operators run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import detect as D
from ..sources.files import documents_as_files


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents that arrive as Parquet files in a folder."""
    return spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").parquet(path)


def findings(documents: DataFrame, suppress: bool = True) -> DataFrame:
    """Masked findings as they arrive; where several detectors agree all are given, since deduplication is for a whole file's rows."""
    c = D.candidates(documents_as_files(documents))
    return D.masked(c.where("passes") if suppress else c)


def write_findings(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
