"""Numbering repeated fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import keep_in_order


def occurrence(df: DataFrame, keys: list[str], order: str = "emit_no", name: str = "idx") -> DataFrame:
    """The n-th appearance of a key, from 1, in order of emission."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))


def forced_occurrence(df: DataFrame, keys: list[str], forced: str = "forced", order: str = "emit_no") -> DataFrame:
    """As ``occurrence``, but a forced index is taken as it is and the count goes on from
    the larger of it and the count so far.

    With u rows so far that are not forced, the count is u plus what forced rows have added,
    and that is the largest of their f - u: two windows in one order.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    free = F.sum(F.when(F.col(forced).isNull(), 1).otherwise(0)).over(w)
    rows = df.withColumn("_u", free)
    ahead = F.greatest(F.lit(0), F.max(F.col(forced) - F.col("_u")).over(w))
    return rows.withColumn("idx", F.coalesce(F.col(forced), F.col("_u") + ahead).cast("long")).drop("_u")


def explicit_index(visits: DataFrame, lookup: DataFrame, keys: list[str], order: str = "emit_no", index: str = "Index", loose: tuple[str, ...] = (), within: tuple[str, ...] = ()) -> DataFrame:
    """The index that each visit of a field takes: the explicit ones of the lookup in
    ascending order, and after these 1, 2, 3 and so on.  Visits are counted anew in each
    of ``within``, a document for example; the lookup has no such columns.

    A visit that is blank (null or empty) in one of the keys ``loose`` takes the indexes of
    all rows of its other keys.  So the lookup's rows are there once for each choice of
    loose keys, and a visit meets those of its own choice: equi-joins only.
    """
    blank = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("")) == ""
    bit = lambda k: 1 << loose.index(k)
    rows = lookup.filter(F.col(index).isNotNull()).select(*keys, F.col(index).alias("_index"))
    choices = F.filter(F.sequence(F.lit(0), F.lit((1 << len(loose)) - 1)), lambda m: reduce(lambda x, k: x & ((m.bitwiseAND(bit(k)) == 0) | ~blank(k)), loose, F.lit(True)))
    held = lambda k: F.when(F.col("_choice").bitwiseAND(bit(k)) != 0, F.col(k)) if k in loose else F.col(k)
    known = rows.withColumn("_choice", F.explode(choices)).select("_choice", *[held(k).alias(f"_{k}") for k in keys], "_index").distinct()
    at = ["_choice", *[f"_{k}" for k in keys]]
    known = known.withColumn("_n", F.row_number().over(Window.partitionBy(*at).orderBy("_index")).cast("long"))
    size = known.groupBy(*at).agg(F.count("*").alias("_size"))
    mine = reduce(lambda x, k: x + F.when(blank(k), 0).otherwise(bit(k)), loose, F.lit(0))
    own = occurrence(visits, [*within, *keys], order, "_n").withColumns({"_choice": mine} | {f"_{k}": F.when(~blank(k), F.col(k)) if k in loose else F.col(k) for k in keys})
    # joined by rank, so that no key's indexes are gathered in one row
    for other, on, tag in ((known, [*at, "_n"], "k"), (size, at, "s")):
        other = other.withColumnsRenamed({c: f"{tag}{c}" for c in on})
        own = own.join(other, reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"{tag}{c}")), on, F.lit(True)), "left")
    idx = F.coalesce("_index", F.col("_n") - F.coalesce("_size", F.lit(0)))
    return own.withColumn("idx", idx.cast("long")).select(*visits.columns, "idx")


def write_once(df: DataFrame, keys: list[str], order: str = "emit_no") -> DataFrame:
    """The first row of each key among those with something to write."""
    some = df.filter("value IS NOT NULL AND value <> ''")
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


#: Points that a checkbox's corners are rounded to when boxes are compared.
GRID = 2.0


def write_once_boxes(df: DataFrame, doc: list[str], keys: list[str], order: str = "emit_no") -> DataFrame:
    """``write_once`` where a checkbox (is_checkbox, with x0, y0, x1 and y1) is also left out
    if one was written to its four corners, rounded to GRID.  Each rule looks at what the
    other let through, so what ``doc`` names, a page, goes in order in one task."""

    corners = [f"_{c}" for c in ("x0", "y0", "x1", "y1")]

    def step(state: tuple[set, set], row: tuple) -> bool:
        (written, places), (box, *at), key = state, row[:5], row[5:]
        if key in written:
            return False
        # a corner that is missing is at no place
        if box and all(c is not None and c == c for c in at):
            if tuple(at) in places:
                return False
            places.add(tuple(at))
        written.add(key)
        return True

    some = df.filter("value IS NOT NULL AND value <> ''").withColumns({f"_{c}": F.rint(F.col(c) / GRID) for c in ("x0", "y0", "x1", "y1")})
    return keep_in_order(some, tuple(doc), [order], ["is_checkbox", *corners, *keys], lambda: (set(), set()), step).drop(*corners)
