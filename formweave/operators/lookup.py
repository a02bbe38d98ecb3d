"""Operators on the lookup sheet: cleaning, removing repeats, value maps and reports.

Rows carry ``row_no``, their order in the sheet: every tie goes to the smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .folding import folded

HEADERS = ("Section", "Page", "Field", "Index", "Value", "Choices")


def require(df: DataFrame, columns=("Field", "Value")) -> DataFrame:
    """``df`` itself; an error names the columns that it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"lookup sheet lacks {', '.join(missing)}")
    return df


def backfill(df: DataFrame, headers=HEADERS) -> DataFrame:
    """Adds the headers that are missing, blank."""
    return df.withColumns({h: F.lit("") for h in headers if h not in df.columns})


def clean(df: DataFrame) -> DataFrame:
    """Typed lookup rows from a sheet of strings.

    Text is trimmed, Page and Index become numbers or null, and rows without a field or
    a value (blank, or ``nan``) go.  A blank section stays blank and constrains nothing.
    """
    df = backfill(require(df))
    text = {h: T.trim_all(F.coalesce(F.col(h).cast("string"), F.lit(""))) for h in ("Section", "Field", "Value", "Choices")}
    df = df.withColumns(text | {"Page": T.clean_page("Page"), "Index": T.clean_index("Index")})
    return df.filter((F.col("Field") != "") & (F.col("Value") != "") & (F.lower("Value") != "nan"))


def with_keys(df: DataFrame, normalizer=T.norm_key) -> DataFrame:
    """Adds field_norm and section_norm, of labels and sections in Unicode's composed form."""
    rows = folded(df.withColumns({"field_norm": F.col("Field"), "section_norm": F.col("Section")}), "field_norm", "section_norm")
    return rows.withColumns({"field_norm": normalizer("field_norm"), "section_norm": normalizer("section_norm")})


def with_defaults(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """Appends defaults behind all rows of the sheet, so any row of the sheet wins."""
    last = df.agg(F.coalesce(F.max("row_no"), F.lit(0)).alias("last"))
    placed = defaults.crossJoin(F.broadcast(last)).withColumn("row_no", F.col("row_no") + F.col("last")).drop("last")
    return df.unionByName(placed, allowMissingColumns=True)


def sections(df: DataFrame) -> DataFrame:
    """Distinct section keys, without blank."""
    return df.select("section_norm").filter("section_norm <> ''").distinct()


def keep_first(df: DataFrame, keys: list[Column | str], order: str = "row_no") -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def dedupe(df: DataFrame) -> DataFrame:
    """First row by section, field and index (no index counts as 1)."""
    return keep_first(df.withColumn("_idx", T.index_or_one("Index")), ["section_norm", "field_norm", "_idx"]).drop("_idx")


def conflicts(df: DataFrame) -> DataFrame:
    """Keys whose rows have different values: the one kept and how many there are."""
    rows = df.groupBy("section_norm", "field_norm", T.index_or_one("Index").alias("idx"))
    return rows.agg(F.min_by("Value", "row_no").alias("kept"), F.count_distinct(F.nullif("Value", F.lit(""))).alias("n_values")).filter("n_values > 1")


def report(df: DataFrame) -> DataFrame:
    """One row: total_rows, kept_rows, deduped and conflicts."""
    keys = df.groupBy("section_norm", "field_norm", T.index_or_one("Index").alias("idx"))
    per = keys.agg(F.count("*").alias("n"), F.count_distinct(F.nullif("Value", F.lit(""))).alias("v"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("*").alias("kept_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("deduped"), F.count_if(F.col("v") > 1).alias("conflicts"))


def sanitize(df: DataFrame) -> DataFrame:
    """One row by section, field and index: the first value that is not blank, and all
    choices that differ, in order."""
    rows = df.groupBy("section_norm", "field_norm", T.index_or_one("Index").alias("idx"))
    first = F.min_by("Value", F.when(F.col("Value") != "", F.col("row_no")))
    choices = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("Choices") != "", F.struct("row_no", "Choices")))), lambda x: x["Choices"]))
    return rows.agg(F.coalesce(first, F.lit("")).alias("value"), F.array_join(choices, " | ").alias("choices"), F.count("*").alias("n"))


def page_counts(fields: DataFrame) -> DataFrame:
    """Fields and different sections of each page."""
    return fields.groupBy("page").agg(F.count("*").alias("n"), F.count_distinct("section").alias("sections"))


def sections_by_page(fields: DataFrame, order: str = "emit_no") -> DataFrame:
    """page and its sections (array) in order of their first field; aggregated before they
    are listed, so a list is as long as a page has sections."""
    first = fields.groupBy("page", "section").agg(F.min(order).alias("first"))
    return first.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "section"))), lambda x: x["section"]).alias("sections"))


def value_maps(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Values by (section, field, idx) and by (field, idx), where the last row wins, and
    by (field, idx) where the first does."""
    rows = df.withColumn("idx", T.index_or_one("Index"))
    last, first = F.max_by("Value", "row_no").alias("value"), F.min_by("Value", "row_no").alias("value")
    return rows.groupBy("section_norm", "field_norm", "idx").agg(last), rows.groupBy("field_norm", "idx").agg(last), rows.groupBy("field_norm", "idx").agg(first)


def values_by_field(df: DataFrame) -> DataFrame:
    """field_norm with its values in order of the rows."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "Value"))), lambda x: x["Value"])
    return df.groupBy("field_norm").agg(values.alias("values"))


def multi_index(df: DataFrame) -> DataFrame:
    """Fields of a section with more than one index, where no index counts as one."""
    n = F.count_distinct("Index") + F.max(F.col("Index").isNull().cast("int"))
    return df.groupBy("section_norm", "field_norm").agg(n.alias("n_index")).filter("n_index > 1")


def simple_rows(df: DataFrame, row: int) -> DataFrame:
    """The sheet of one header for each field: field and value of one row (from 0)."""
    names = [c for c in df.columns if c != "row_no"]
    one = df.filter(F.col("row_no") == row).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names])
    return one.unpivot([], names, "field", "value")
