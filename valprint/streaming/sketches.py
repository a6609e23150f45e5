"""Value sets kept up to date over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valprint.functions import sketch


def new_members(events: DataFrame, domain: str, value: str, time: str, late: str = "1 hour") -> DataFrame:
    """domain, value and time of each value when a stream first shows it within the watermark.

    State holds the keys of the watermark alone; the sink keeps the whole set, as later repeats are merged there.
    """
    return events.withWatermark(time, late).select(domain, value, time).dropDuplicatesWithinWatermark([domain, value])


def windowed_sets(events: DataFrame, domain: str, value: str, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, domain and the set of values of each window, once the watermark has passed it. merge() joins windows."""
    kept = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(domain))
    return kept.agg(sketch.build(value).alias("members")).select(F.col("w.start").alias("start"), domain, "members")
