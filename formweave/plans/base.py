"""Inputs of the queries, derived from the driver's tables.

The driver has no forms, so fields, sheets and positioned text are made of its tables.
Each input is one list of SQL expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEGMENT = "CASE {0} % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'AUTOMOBILE' WHEN 2 THEN 'MACHINERY' WHEN 3 THEN 'HOUSEHOLD' ELSE 'FURNITURE' END"

INPUTS: dict[str, tuple[str, str, str]] = {
    # name: (table, condition, expressions)
    "raw_sheet": (
        "customer",
        "TRUE",
        f"""c_custkey AS row_no, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '  ' || {SEGMENT.format('c_custkey')} || ' ' END AS Section,
        CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_nationkey % 4 AS STRING) || '.0' END AS Page,
        'Account  Field ' || CAST(CAST(floor(c_custkey / 6) AS BIGINT) AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN ':' ELSE '' END AS Field,
        CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '#' || CAST(c_custkey % 4 AS STRING) END AS Index,
        CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'NaN' ELSE c_name END AS Value,
        CASE WHEN c_custkey % 6 = 0 THEN 'Choice ' || CAST(c_nationkey AS STRING) ELSE '' END AS Choices""",
    ),
    "sheet": (
        "customer",
        "TRUE",
        f"""c_custkey AS row_no, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lower({SEGMENT.format('c_custkey')}) END AS section_norm,
        CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_nationkey % 4 AS BIGINT) END AS Page,
        'account field ' || CAST(CAST(floor(c_custkey / 6) AS BIGINT) AS STRING) AS field_norm,
        CASE WHEN floor(c_custkey / 6) % 3 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS BIGINT) END AS Index,
        CASE WHEN c_custkey % 17 = 0 THEN '' ELSE c_name END AS Value, 'Choice ' || CAST(c_nationkey AS STRING) AS Choices""",
    ),
    "fields": (
        "orders",
        "TRUE",
        f"""o_orderkey AS field_no, 'account field ' || CAST(CAST(floor(o_custkey / 6) AS BIGINT) AS STRING) AS label_norm,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS BIGINT) END AS page,
        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE lower({SEGMENT.format('o_orderkey')}) END AS section_norm,
        CAST(o_orderkey % 4 AS BIGINT) AS occ""",
    ),
    "visits": (
        "lineitem",
        "TRUE",
        "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS emit_no, CAST(l_suppkey % 3 AS BIGINT) AS page, lower(l_returnflag) AS section, l_partkey AS label, l_linestatus AS value_flag",
    ),
    "slots": (
        "lineitem",
        "TRUE",
        """CAST(floor(l_orderkey / 40) AS BIGINT) AS doc_id, CAST(l_suppkey % 2 AS BIGINT) AS page, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS field_no,
        CAST((l_partkey * 11) % 500 AS DOUBLE) AS x0, CAST((l_partkey * 11) % 500 + 60 AS DOUBLE) AS x1, CAST((l_partkey * 17) % 700 AS DOUBLE) AS y""",
    ),
    "blocks": (
        "lineitem",
        "TRUE",
        """CAST(floor(l_orderkey / 40) AS BIGINT) AS doc_id, CAST(l_suppkey % 2 AS BIGINT) AS page, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS block_no,
        CAST((l_partkey * 7) % 500 AS DOUBLE) AS x0, CAST((l_partkey * 7) % 500 + 30 + l_suppkey % 40 AS DOUBLE) AS x1,
        CAST((l_partkey * 13) % 700 AS DOUBLE) AS y0, CAST((l_partkey * 13) % 700 + 10 AS DOUBLE) AS y1,
        CASE l_suppkey % 9 WHEN 0 THEN 'Yes' WHEN 1 THEN '(no)' ELSE 'block ' || CAST(l_partkey AS STRING) END AS text""",
    ),
    "spans": (
        "lineitem",
        "TRUE",
        """CAST(floor(l_orderkey / 8) AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS page, CAST(l_orderkey % 8 AS BIGINT) AS line_no,
        CAST(l_linenumber AS BIGINT) AS span_no, CAST((l_linenumber * 90 + l_partkey % 70) AS DOUBLE) AS x0,
        CAST((l_linenumber * 90 + l_partkey % 70 + 20 + l_suppkey % 40) AS DOUBLE) AS x1, CAST((l_orderkey % 8) * 30 AS DOUBLE) AS y0,
        CAST((l_orderkey % 8) * 30 + 10 AS DOUBLE) AS y1, CAST(8 + l_quantity % 9 AS DOUBLE) AS size, 'w' || CAST(l_partkey AS STRING) AS text""",
    ),
    "cells": (
        "lineitem",
        "TRUE",
        """CAST(floor(l_orderkey / 5) AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS table_no, CAST(l_orderkey % 5 AS BIGINT) AS row_no,
        CAST(l_linenumber - 1 AS BIGINT) AS col_no, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'cell ' || CAST(l_partkey % 50 AS STRING) END AS text""",
    ),
    "stream": (
        "events",
        "TRUE",
        """user_id AS doc_id, event_id AS block_no, event_type AS kind, CAST(event_id % 5 AS BIGINT) AS page,
        CASE WHEN event_type = 'error' THEN 'Section ' || CAST(event_id AS STRING) ELSE 'label ' || CAST(event_id AS STRING) END AS text, value""",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input by its name."""
    source, condition, expressions = INPUTS[name]
    parts, depth, at = [], 0, 0
    for i, c in enumerate(expressions):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(expressions[at:i])
            at = i + 1
    return table(spark, sf_dir, source).filter(condition).selectExpr(*parts, expressions[at:])


def sql_of(name: str) -> str:
    """The same input as a parenthesised query."""
    source, condition, expressions = INPUTS[name]
    return f"(SELECT {expressions} FROM {source} WHERE {condition})"


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL that must give its rows; ``{input}`` in the SQL is
    that input."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            text = sql
            for k in INPUTS:
                text = text.replace("{" + k + "}", sql_of(k))
            ORACLES[name] = text
        return f

    return add


# SQL of the normalisers on ASCII text.
def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def no_punct(x: str) -> str:
    return f"regexp_replace({x}, '[!-/:-@\\[-`{{-~]', '', 'g')"


def no_parens(x: str) -> str:
    return f"regexp_replace({x}, '\\(.*?\\)', '', 'g')"
