"""Scalar expressions and line operators on the seeds of the survey."""

from pyspark.sql import functions as F

from granella.functions import text as T
from granella.operators import extract as X
from granella.operators import geometry as G
from granella.operators import lines as L


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


def test_br_numbers(spark):
    assert one(spark, "8.958,97", T.parse_br_number) == 8958.97
    assert one(spark, "6.956", T.parse_br_number) == 6.956
    assert one(spark, "abc", T.parse_br_number) == 0.0
    assert one(spark, None, T.parse_br_number) == 0.0


def test_masks(spark):
    assert one(spark, "12345678000190", T.normalise_cnpj) == "12.345.678/0001-90"
    assert one(spark, "123", T.normalise_cnpj) == ""
    assert one(spark, "CREASP-54321D", T.normalise_crea) == "SP-54321/D"
    assert one(spark, "SP 54321", T.normalise_crea) == "SP-54321" and one(spark, "CREA 54321", T.normalise_crea) == ""
    assert one(spark, "2457/2023", T.admin_number_score) == 45 and one(spark, "245712029", T.admin_number_score) == -20 and one(spark, " ", T.admin_number_score) == -1
    assert one(spark, "AREA  DO TERREO\n\n\n 50 M2", T.repair_ocr) == "ÁREA DO TÉRREO\n\n50 m²"
    assert one(spark, "a & <b>", T.escape_xml) == "a &amp; &lt;b&gt;"


def test_units(spark):
    text = "(1º AO 202) PAV. TIPO - 55,00 X 4 APTOS\n(1º AO 20º) PAV. TIPO - 55,00 X 4 APTOS\n(1º AO 20º) PAV. TIPO - X 4 APTOS\n7 APTOS\n2 APTOS/PAV\n60,5 x 3 apartamentos"
    got = X.units(spark.createDataFrame([("d", text), ("e", None)], "doc string, text string"))
    assert sorted((r["area"], r["qty"], r["top"]) for r in got.collect()) == [(0.0, 7, 20), (55.0, 4, 20), (60.5, 3, 20)]


def test_floors(spark):
    rows = [("a", "PAV. TÉRREO\n1º AO 202\nCOBERTURA"), ("b", "TERREO"), ("c", "12 PAVIMENTOS E TERREO"), ("d", "3º AO 9º")]
    got = X.floor_count(spark.createDataFrame(rows, "doc string, text string"))
    assert {r["doc"]: r["floors"] for r in got.collect()} == {"a": 22, "b": 0, "c": 13, "d": 9}


def test_merge_tolerance(spark):
    rows = [(1, "h", 100.0, 0.0, 50.0), (1, "h", 100.0, 52.0, 80.0), (1, "h", 101.0, 95.0, 99.0), (1, "h", 120.0, 0.0, 1.0)]
    got = G.merge_segments(spark.createDataFrame(rows, "page int, orient string, pos double, start double, end double"))
    assert sorted((r["start"], r["end"], r["sources"]) for r in got.collect()) == [(0.0, 1.0, 1), (0.0, 80.0, 2), (95.0, 99.0, 1)]


def test_envelope_round_trip(spark):
    docs = spark.createDataFrame([("a", "x\ny"), ("b", "")], "name string, body string")
    joined = docs.orderBy("name").select(F.collect_list(L.page_envelope(F.col("name"), F.lit(1), F.col("body"))).alias("p")).select(F.concat_ws("\n", "p").alias("text"))
    assert [(r["name"], r["body"].rstrip("\n")) for r in L.split_documents(joined).orderBy("position").collect()] == [("a", "x\ny"), ("b", "")]
