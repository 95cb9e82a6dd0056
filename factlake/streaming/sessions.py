"""Live entries of a cache with a sliding lifetime, as session windows; the same for streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(accesses: DataFrame, key: str, ts: str, ttl: str, watermark: str | None = None) -> DataFrame:
    """``(key, opened, closed, n)``: runs of uses less than ``ttl`` apart; closed is ``ttl`` after the last.

    With a ``watermark`` a stream emits a run once no late use can extend it, and drops later ones.
    """
    rows = accesses.withColumn("_at", F.col(ts).cast("timestamp"))
    if watermark:
        rows = rows.withWatermark("_at", watermark)
    runs = rows.groupBy(key, F.session_window("_at", ttl).alias("w")).agg(F.count("*").alias("n"))
    return runs.select(key, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n")
