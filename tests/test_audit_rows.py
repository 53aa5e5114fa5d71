"""An audit judges a document within its row: cells are neither shuffled nor joined by their place."""

import pytest
from pyspark.sql import functions as F

from granella.functions import schema as S
from granella.functions.text import equivalent
from granella.operators import workbook as W
from granella.plans.queries import QUERIES


def test_audit_query_shuffles_no_cells(spark, sf):
    plan = QUERIES["q30_cells_audit"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ref#" not in "".join(x for x in plan.splitlines() if "Exchange" in x or "Join" in x or "Generate" in x)


def test_audit_of_workbooks(spark):
    records = spark.range(3).select(F.col("id").cast("string").alias("doc"), S.build(S.TREE, {"incorporador.nome": F.lit("ANA"), "projeto.areaTerreno": F.lit(2.5)}).alias("record"))
    wanted = W.sheet_cells(records).filter("doc <> '2'").select("doc", "ref", F.when((F.col("doc") == "1") & (F.col("field") == "incorporador.nome"), "EVA").otherwise(F.col("value")).alias("value"))
    odd = spark.createDataFrame([("0", None, "x"), ("0", "NADA!A1", "x"), ("9", "NADA!A1", "x")], "doc string, ref string, value string")
    got = {r["doc"]: r for r in W.audit(records, wanted.union(odd).union(wanted)).collect()}
    n = W.expected_cells(records).filter("doc = '0'").count()
    assert sorted(got) == ["0", "1", "2"]
    assert got["0"]["ok"] and got["0"]["celulas_verificadas"] == n and not got["0"]["erro"]
    assert not got["1"]["ok"] and [tuple(d) for d in got["1"]["divergencias"]] == [(f"{W.INFO_SHEET}!{W.INFO_CELLS['incorporador.nome']}", "incorporador.nome", "ANA", "EVA")]
    assert (got["2"]["ok"], got["2"]["celulas_verificadas"], got["2"]["erro"]) == (False, 0, "planilha nao encontrada")


@pytest.mark.parametrize("a, b, same", [("NaN", "NaN", False), ("1e999", "1e999", False), ("Sala", " Sala ", True), (None, "0.0", True), (" ", None, True), ("2.5", "2.5004", True), ("2.5", "2.6", False), ("x", None, False), ("1", "x", False)])
def test_equivalent(spark, a, b, same):
    assert spark.range(1).select(equivalent(F.lit(a).cast("string"), F.lit(b).cast("string"))).first()[0] is same
