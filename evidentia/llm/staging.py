"""Intermediate tables, as in the rest of the library, and the size of Arrow batches of texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..staging import drop_path, new_path, shared_dir, staged

__all__ = ["drop_path", "new_path", "shared_dir", "small_batches", "staged"]

#: Rows and bytes of an Arrow batch of texts.
ROWS, BYTES = 1000, 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: Arrow batches of ROWS of them and of BYTES at most, unless the session names its own numbers."""
    for name, usual, own in (("maxRecordsPerBatch", "10000", str(ROWS)), ("maxBytesPerBatch", None, str(BYTES))):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, own)
