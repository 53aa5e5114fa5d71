"""Formulas of workbooks, as a relation of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granella.functions.text import is_formula


def without_formulas(cells: DataFrame, template: DataFrame) -> DataFrame:
    """Cells whose place holds no formula in the template (ref, value)."""
    return cells.join(template.filter(is_formula(F.col("value"))).select("ref"), "ref", "left_anti")


def formula_inventory(cells: DataFrame) -> DataFrame:
    """Formulas by sheet, and in all (sheet null)."""
    return cells.filter(is_formula(F.col("value"))).rollup("sheet").agg(F.count("*").alias("formulas"))
