"""Unicode folding of labels and sections through a dictionary of the different ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..sources.shared import cut

#: Strings and bytes of a dictionary that is broadcast; a larger one is joined by shuffles.
STRINGS, BYTES = 1 << 16, 1 << 23


def folded(rows: DataFrame, *columns: str, form=S.nfkc) -> DataFrame:
    """``rows`` with these string columns in Unicode form ``form``.

    Only strings beyond ASCII change, so the different ones of all columns are folded once
    each, and rows meet them by equality; the others never leave the JVM.  Nulls stay.
    """
    odd = lambda c: F.col(c).rlike(r"[^\x00-\x7F]")
    texts = reduce(DataFrame.unionByName, [rows.filter(odd(c)).select(F.col(c).alias("_text")) for c in columns]).distinct()
    table = cut(texts.select("_text", form("_text").alias("_form")).filter("_text <> _form"))
    n, size = table.agg(F.count("*"), F.sum(F.octet_length("_text") + F.octet_length("_form"))).first()
    if not n:
        return rows
    small = n <= STRINGS and size <= BYTES
    for c in columns:
        # rows without an entry are spread, not gathered under one key
        key = F.when(odd(c), F.col(c)) if small else F.when(odd(c), F.col(c)).otherwise(F.concat(F.lit("\0"), F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 16)).cast("string")))
        met = rows.withColumn("_text", key).join(F.broadcast(table) if small else table, "_text", "left")
        rows = met.withColumn(c, F.coalesce("_form", c)).drop("_text", "_form")
    return rows
