"""Inputs of queries that are written once, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TABLE, _SPLIT = re.compile(r"\{(\w+)\}"), re.compile(r"(\{\w+\})")


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of SQL in which ``{orders}`` stands for a table of the folder."""
    names = set(_TABLE.findall(sql))
    # braces that name no table are text
    parts = [p if i % 2 else p.replace("{", "{{").replace("}", "}}") for i, p in enumerate(_SPLIT.split(sql))]
    return spark.sql("".join(parts), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def named(sql: str) -> str:
    """The same SQL over DuckDB's views."""
    return _TABLE.sub(r"\1", sql)


def with_inputs(final: str, **inputs: str) -> str:
    """DuckDB SQL of a query over inputs by name."""
    return "WITH " + ", ".join(f"{name} AS ({named(sql)})" for name, sql in inputs.items()) + " " + final
