"""Ordered scans: carrying headings along, looking ahead, and greedy selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T
from ..functions.registered import CELL, PAD, Grid


def forward_fill(fields: DataFrame, keys: tuple = ("doc_id",), order: tuple = ("page", "y", "x", "idx")) -> DataFrame:
    """Fields with a blank section take that of the last heading before them; headings
    (is_section) stay as rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("is_section"), F.col("label")), ignorenulls=True).over(w)
    return fields.withColumn("section", F.when(F.col("is_section"), F.col("label")).otherwise(F.coalesce(F.nullif("section", F.lit("")), head, F.lit(""))))


def carry(blocks: DataFrame, is_heading: Column, keys: tuple = ("doc_id",), order: str = "block_no", name: str = "section") -> DataFrame:
    """The last heading so far, that of the row itself included."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn(name, F.last(F.when(is_heading, T.strip_colons("text")), ignorenulls=True).over(w))


def carry_columns(cells: DataFrame) -> DataFrame:
    """``Contact N`` in a cell holds for its column from there down."""
    found = F.regexp_extract("text", r"(?i)^\s*contact\s+(\d+)\s*$", 1)
    w = Window.partitionBy("doc_id", "table_no", "col_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("contact", F.last(F.nullif(found, F.lit("")).cast("long"), ignorenulls=True).over(w))


def carry_headers(cells: DataFrame) -> DataFrame:
    """A blank header cell takes the last header to its left."""
    w = Window.partitionBy("doc_id", "table_no", "row_no").orderBy("col_no").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("header", F.last(F.nullif(F.trim("text"), F.lit("")), ignorenulls=True).over(w))


def label_then_blank(blocks: DataFrame) -> DataFrame:
    """Labels whose next block is a line to fill in."""
    nxt = F.lead("text").over(Window.partitionBy("doc_id").orderBy("block_no"))
    rows = blocks.withColumn("_next", nxt)
    blank = T.is_blank_line("_next") & F.col("_next").isNotNull()
    return rows.filter(blank & ~T.is_blank_line("text") & T.is_short_label("text")).select("doc_id", "block_no", T.strip_colons("text").alias("label"))


def docx_pages(blocks: DataFrame) -> DataFrame:
    """Page of each block: one more for every break before it."""
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("page", (F.coalesce(F.sum(F.col("is_break").cast("int")).over(w), F.lit(0)) + 1).cast("long"))


def matrices(cells: DataFrame) -> DataFrame:
    """Tables under a row of two short labels or more: the row and how many blank rows
    follow it without a gap.  A matrix is skipped before the next is looked for."""

    short = T.is_short_label("text", 4, 140) & F.col("text").rlike(r"\p{L}")
    # a label opens a matrix; cells of blank rows hold nothing but filler
    per = cells.groupBy("doc_id", "table_no", "row_no").agg(F.count_if(short).alias("labels"), F.min(T.is_placeholder_text("text")).alias("blank"))
    # a blank row that follows the row before it without a gap goes with it; of the rows that
    # go together the first of labels opens the matrix, which has all that are below it
    order = Window.partitionBy("doc_id", "table_no").orderBy("row_no")
    begins = F.when(F.col("blank") & (F.col("row_no") == F.lag("row_no").over(order) + 1), 0).otherwise(1)
    per = per.withColumn("_begins", begins).withColumn("_part", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("labels") >= 2, F.col("row_no")))
    parts = per.groupBy("doc_id", "table_no", "_part").agg(first.alias("row_no"), F.max("row_no").alias("_last")).filter("_last > row_no")
    return parts.select("doc_id", "table_no", "row_no", (F.col("_last") - F.col("row_no")).alias("n_rows"))


def row_matrix(cells: DataFrame) -> DataFrame:
    """Rows of checkboxes under a header: a field for each header under the section of the
    row's label where two cells or more are boxes, else one field."""
    head = cells.filter("row_no = 0 AND col_no > 0").select("doc_id", "table_no", "col_no", F.col("text").alias("header"))
    body = cells.filter("row_no > 0").withColumn("_box", T.has_checkbox("text") | (F.trim("text") == ""))
    label = F.max(F.when(F.col("col_no") == 0, F.col("text"))).over(Window.partitionBy("doc_id", "table_no", "row_no"))
    boxes = F.count_if(F.col("_box") & (F.col("col_no") > 0)).over(Window.partitionBy("doc_id", "table_no", "row_no"))
    rows = body.withColumns({"_label": label, "_boxes": boxes}).filter("col_no > 0 AND _box").join(head, ["doc_id", "table_no", "col_no"])
    many = rows.filter("_boxes >= 2").select("doc_id", "table_no", "row_no", F.col("header").alias("label"), F.col("_label").alias("section"))
    one = rows.filter("_boxes < 2").select("doc_id", "table_no", "row_no", F.col("_label").alias("label"), F.lit("").alias("section"))
    return many.unionByName(one)


def keep_in_order(df: DataFrame, keys: tuple, order: list, columns: list[str], fresh: Callable[[], object], step: Callable[[object, tuple], bool], number: str | None = None) -> DataFrame:
    """The rows for which ``step(state, row)`` is true, when the rows of each key go in order
    with a state of their own.  For choices that depend on all choices before them: a key,
    such as a page, goes in one task, and a task holds one state and no list of rows.

    With ``number`` a column of that name counts the rows that are kept, from 1 for each value
    of the first key, whose rows all go in one task then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n = None, None, 0
        for batch in batches:
            keep, counted = [], []
            for at, row in zip(zip(*[batch.column(k).to_pylist() for k in keys]), zip(*[batch.column(c).to_pylist() for c in columns])):
                if at != key:
                    n = n if key is not None and at[0] == key[0] else 0
                    key, state = at, fresh()
                kept = step(state, row)
                keep.append(kept)
                if kept:
                    n += 1
                    counted.append(n)
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(counted, pa.int64())], names=[*out.schema.names, number]) if number else out

    made = {f"_o{i}": o for i, o in enumerate(order) if not isinstance(o, str)}
    rows = df.withColumns(made).repartition(*keys[: 1 if number else None])
    rows = rows.sortWithinPartitions(*keys, *[o if isinstance(o, str) else f"_o{i}" for i, o in enumerate(order)])
    schema = T_.StructType([*df.schema.fields, T_.StructField(number, T_.LongType())]) if number else df.schema
    return rows.select(*df.columns).mapInArrow(run, schema)


# Drawn lines are one if they differ by less than this.
SAME_LINE = {"y0": 0.8, "x0": 2.0, "x1": 2.0}


def merge_near(items: DataFrame, near: dict[str, float] = SAME_LINE, keys: tuple = ("doc_id", "page")) -> DataFrame:
    """Items in order of ``near``'s first two columns, rounded to one decimal, without those
    that differ from the last one kept by less than ``near`` in each column.  Among equals
    the other columns of ``near``, and then all columns, decide, so reruns agree."""
    columns = list(near)

    def step(last: list, place: tuple) -> bool:
        if last and all(abs(a - b) < t for a, b, t in zip(place, last[0], near.values())):
            return False
        last[:] = [place]
        return True

    order = [*[F.bround(c, 1) for c in columns[:2]], *columns, *[c for c in items.columns if c not in {*columns, *keys}]]
    return keep_in_order(items, keys, order, columns, list, step)




def greedy_boxes(boxes: DataFrame, keys: tuple = ("doc_id", "page"), pad: float = PAD) -> DataFrame:
    """Boxes in order of priority and place that overlap none kept before them, when each
    is ``pad`` wider on all sides; boxes that touch overlap."""

    return keep_in_order(boxes, keys, ["priority", "y0", "x0", "box_no"], ["x0", "y0", "x1", "y1"], lambda: Grid(pad, CELL), lambda grid, box: grid.take(*box))


def suppress(candidates: DataFrame, existing: DataFrame, dy: float = 9, dx: float = 36) -> DataFrame:
    """Candidates without an existing line within ``dy`` that overlaps by ``dx``.  What
    exists is what earlier passes left: candidates don't suppress each other."""
    e = existing.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), F.col("x0").alias("ex0"), F.col("x1").alias("ex1"), F.col("y").alias("ey"))
    e = e.withColumn("band", F.explode(F.sequence(F.floor((F.col("ey") - dy) / dy), F.floor((F.col("ey") + dy) / dy))))
    near = (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & (F.floor(F.col("y") / dy) == F.col("band")) & (F.abs(F.col("y") - F.col("ey")) <= dy)
    return candidates.join(e, near & (F.least("x1", "ex1") - F.greatest("x0", "ex0") >= dx), "left_anti")
