"""The registry of queries and their SQL, and what their modules share.

The tables hold no construction documents, so each query derives its input
from table columns by a formula that both sides share. Patterns in SQL are the
library's own, as far as DuckDB's expressions have them (no look-around).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granella.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


NUMBERED = "li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS n FROM lineitem)"


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with a line number n that is unique within its order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf, "lineitem").withColumn("n", F.row_number().over(w))


def texts(lines: DataFrame, key: str = "doc") -> DataFrame:
    """(doc, text) of lines (doc, line_no, line), in order."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("text"))


def pick(words: tuple, i: Column) -> Column:
    """The i-th of some words, from 0."""
    return F.get(F.array(*map(F.lit, words)), i.cast("int"))


def sql_list(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def like(column: str, pattern: str, flags: str = "(?i)") -> str:
    """SQL: whether a column matches."""
    return f"regexp_matches({column}, {quoted(flags + pattern)})"


def all_of(column: str, pattern: str, group: int = 0, flags: str = "(?i)") -> str:
    """SQL: a group of every match."""
    return f"regexp_extract_all({column}, {quoted(flags + pattern)}, {group})"


def less(column: str, pattern: str, by: str = "", flags: str = "(?i)") -> str:
    """SQL: a column with every match replaced."""
    return f"regexp_replace({column}, {quoted(flags + pattern)}, {quoted(by)}, 'g')"
