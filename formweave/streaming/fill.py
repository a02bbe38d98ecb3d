"""Filling fields as they arrive.

A stream of field definitions is resolved against a sheet that is there.  Numbering the
fields of a label needs all earlier ones, so it is stateful: the count of each key is kept
between batches by ``foreachBatch`` in a table of counts, which each batch reads and adds to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def resolve_stream(fields: DataFrame, lookup: DataFrame) -> DataFrame:
    """Streaming ``fields`` (field_no, section, label, idx) with the value of the sheet's
    row of that section, label and index.  A stream-static join without state: the sheet
    is broadcast if the planner finds it small."""
    rows = lookup.groupBy("section_norm", "field_norm", T.index_or_one("Index").alias("idx")).agg(F.min_by("Value", "row_no").alias("value"))
    keyed = fields.withColumns({"section_norm": T.norm_key("section"), "field_norm": T.norm_key("label")})
    return keyed.join(rows, ["section_norm", "field_norm", "idx"], "left").select("field_no", "section", "label", "idx", "value")


def first_values(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A streaming sheet (ts, section_norm, field_norm, Index, Value) without repeats: rows
    of a key within ``delay`` of each other count once; older state is dropped."""
    keyed = rows.withColumn("idx", T.index_or_one("Index")).withWatermark("ts", delay)
    return keyed.dropDuplicatesWithinWatermark(["section_norm", "field_norm", "idx"])


def number_batch(batch: DataFrame, counts: DataFrame, keys: list[str], order: str = "emit_no") -> tuple[DataFrame, DataFrame]:
    """Numbers the fields of a batch after those counted so far.

    Returns the batch with idx, and the new counts (keys, n).
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    numbered = batch.withColumn("_r", rank).join(counts, keys, "left").withColumn("idx", (F.col("_r") + F.coalesce("n", F.lit(0))).cast("long")).drop("_r", "n")
    fresh = batch.groupBy(*keys).agg(F.count("*").alias("n"))
    return numbered, counts.unionByName(fresh).groupBy(*keys).agg(F.sum("n").alias("n"))


def events_by_window(events: DataFrame, size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Fill events (ts, event_type, value) counted and summed by window; late data within
    ``delay`` is added."""
    windows = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
