"""Queries of texts and lines: units, floors, numbers, dates, repairs, documents and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granella.functions import text as T
from granella.operators import extract as X
from granella.operators import finishes as FI
from granella.operators import lines as L
from granella.operators import prices as PR
from granella.operators import sections as SE
from granella.plans import model as M
from granella.plans.registry import NUMBERED, numbered, query, texts
from granella.session import table

# ---- units: one line for each order line -----------------------------------------------------------------------------

_UNIT_SQL = """units AS (SELECT DISTINCT l_orderkey AS doc, l_partkey % 90 + 30 + (l_suppkey % 100) / 100.0::DOUBLE AS area, l_quantity::INT AS qty, max(l_linenumber) OVER (PARTITION BY l_orderkey)::INT AS top FROM lineitem)"""


def _unit_docs(spark: SparkSession, sf: str) -> DataFrame:
    line = F.format_string("(1º AO %dº) PAV. TIPO - %d,%02d X %d APTOS", "l_linenumber", F.col("l_partkey") % 90 + 30, F.col("l_suppkey") % 100, F.col("l_quantity").cast("int"))
    return texts(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line_no"), line.alias("line")))


@query(f"WITH {_UNIT_SQL} SELECT doc, area, qty, top FROM units")
def q01_units_by_doc(spark, sf):
    return X.units(_unit_docs(spark, sf))


@query(f"""WITH {_UNIT_SQL} SELECT doc, count(*) AS kinds, sum(qty)::BIGINT AS units, round(sum(area * qty), 2) AS area_total, max(top) AS floors, round((round(sum(area * qty), 3) / max(top))::DECIMAL(18, 9), 3)::DOUBLE AS typical_area FROM units GROUP BY doc""")
def q02_typical_floor(spark, sf):
    return X.unit_totals(X.units(_unit_docs(spark, sf)))


@query(f"""WITH {NUMBERED}, l AS (SELECT l_orderkey AS doc, n, CASE WHEN l_linenumber % 7 = 3 THEN 'PAV. TERREO' WHEN l_linenumber % 7 = 5 THEN 'COBERTURA' WHEN l_suppkey % 3 = 0 THEN 'RESUMO'
      ELSE '1º AO ' || (CASE WHEN l_partkey % 5 = 0 THEN (l_partkey % 40 + 10)::VARCHAR || '2' ELSE (l_partkey % 40 + 3)::VARCHAR END) END AS line FROM li),
  t AS (SELECT *, try_cast(nullif(regexp_extract(line, '1º AO ([0-9]+)', 1), '') AS INT) AS v FROM l),
  u AS (SELECT doc, n, line, CASE WHEN v >= 100 AND v % 10 = 2 THEN v // 10 ELSE v END AS top FROM t)
SELECT doc, CASE WHEN arg_min(top, n) FILTER (WHERE top IS NOT NULL) IS NULL THEN 0 ELSE (arg_min(top, n) FILTER (WHERE top IS NOT NULL)) + max((line = 'PAV. TERREO')::INT) + max((line = 'COBERTURA')::INT) END::INT AS floors FROM u GROUP BY doc""")
def q03_num_floors(spark, sf):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    line = F.when(n % 7 == 3, "PAV. TERREO").when(n % 7 == 5, "COBERTURA").when(F.col("l_suppkey") % 3 == 0, "RESUMO").otherwise(F.concat(F.lit("1º AO "), F.when(p % 5 == 0, F.concat((p % 40 + 10).cast("string"), F.lit("2"))).otherwise((p % 40 + 3).cast("string"))))
    return X.floor_count(texts(numbered(spark, sf).select(F.col("l_orderkey").alias("doc"), F.col("n").alias("line_no"), line.alias("line"))))


@query("""WITH p AS (SELECT l_orderkey AS doc, max(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 60 ELSE 0 END)::INT AS common, max(CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey % 25 ELSE 0 END)::INT AS double FROM lineitem GROUP BY 1)
SELECT doc, common, double, concat_ws('; ', CASE WHEN common > 0 THEN common || ' vagas comuns' END, CASE WHEN double > 0 THEN double || ' vagas duplas' END) AS text FROM p""")
def q04_parking_max(spark, sf):
    n = F.col("l_linenumber")
    line = F.when(n % 2 == 0, F.concat(F.lit("TOTAL DE VAGAS COMUNS: "), (F.col("l_partkey") % 60).cast("string"))).otherwise(F.concat(F.lit("TOTAL DE VAGAS DUPLAS: "), (F.col("l_suppkey") % 25).cast("string")))
    return X.parking(texts(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), n.alias("line_no"), line.alias("line"))))


@query("""SELECT l_orderkey AS doc, l_linenumber AS line_no, replace(replace(replace(format('{:,.2f}', l_extendedprice), ',', '_'), '.', ','), '_', '.') AS brl, round(l_extendedprice, 2) AS parsed FROM lineitem""")
def q05_br_number(spark, sf):
    brl = T.format_brl(F.col("l_extendedprice"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line_no"), brl.alias("brl"), T.parse_br_number(brl).alias("parsed"))


@query("""WITH d AS (SELECT c_custkey, lpad((c_custkey * 7919 % 100000000)::VARCHAR, 8, '0') || '0001' || lpad((c_custkey % 97)::VARCHAR, 2, '0') AS d, lpad((c_custkey % 90000 + 10000)::VARCHAR, 5, '0') AS n FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE d[1:2] || '.' || d[3:5] || '.' || d[6:8] || '/' || d[9:12] || '-' || d[13:14] END AS cnpj, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'SP-' || n || '/D' WHEN 2 THEN 'SP-' || n || '/D' WHEN 3 THEN 'PR-' || n ELSE 'SC-' || n || '/D' END AS crea FROM d""")
def q06_cnpj_crea_normalise(spark, sf):
    k = F.col("c_custkey")
    d = F.concat(F.lpad((k * 7919 % 100000000).cast("string"), 8, "0"), F.lit("0001"), F.lpad((k % 97).cast("string"), 2, "0"))
    raw = F.when(k % 11 == 0, F.substring(d, 1, 12)).otherwise(F.concat(F.lit("CNPJ "), F.substring(d, 1, 2), F.lit(" . "), F.substring(d, 3, 12)))
    n = F.lpad((k % 90000 + 10000).cast("string"), 5, "0")
    spelled = lambda a, b: F.concat(F.lit(a), n, F.lit(b))
    crea = F.when(k % 5 == 0, spelled("CREA ", "")).when(k % 5 == 1, spelled("CREA SP ", "/D")).when(k % 5 == 2, spelled("CREASP-", "D")).when(k % 5 == 3, spelled("crea pr-", "")).otherwise(spelled(" sc", " d"))
    return table(spark, sf, "customer").select("c_custkey", T.normalise_cnpj(raw).alias("cnpj"), T.normalise_crea(crea).alias("crea"))


_POINTS = """(CASE WHEN regexp_matches(permit, '/20[0-9]{2}') THEN 25 ELSE 0 END + CASE WHEN regexp_matches(permit, '^[0-9]{1,6}/[0-9]{4}$') THEN 20 WHEN contains(permit, '/') AND length(permit) <= 24 THEN 12 WHEN regexp_matches(permit, '^[0-9]{3,6}$') THEN 8 ELSE 0 END
  - CASE WHEN length(permit) >= 9 AND NOT contains(permit, '/') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(permit, '^[0-9]+\\.[0-9]+\\.[0-9]+/') THEN 15 ELSE 0 END)::INT"""


@query(f"""WITH {NUMBERED}, c AS (SELECT l_orderkey AS doc, n AS line_no, CASE l_partkey % 5 WHEN 0 THEN (l_partkey % 9000 + 1000) || '/' || (2010 + l_suppkey % 10) WHEN 1 THEN (l_partkey % 900000 + 100000)::VARCHAR WHEN 2 THEN (1000000000 + l_partkey)::VARCHAR WHEN 3 THEN '1.2.' || l_partkey || '/9' ELSE (l_partkey % 90 + 10) || '/1' END AS permit FROM li),
  s AS (SELECT *, {_POINTS} AS score FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, line_no) AS rn FROM s)
SELECT doc, CASE WHEN score < 0 THEN '' ELSE permit END AS permit, score FROM r WHERE rn = 1""")
def q07_best_permit(spark, sf):
    p = F.col("l_partkey")
    s = lambda c: c.cast("string")
    permit = F.when(p % 5 == 0, F.concat(s(p % 9000 + 1000), F.lit("/"), s(F.col("l_suppkey") % 10 + 2010))).when(p % 5 == 1, s(p % 900000 + 100000)).when(p % 5 == 2, s(p + 1000000000)).when(p % 5 == 3, F.concat(F.lit("1.2."), s(p), F.lit("/9"))).otherwise(F.concat(s(p % 90 + 10), F.lit("/1")))
    return X.best_permit(numbered(spark, sf).select(F.col("l_orderkey").alias("doc"), F.col("n").alias("line_no"), permit.alias("permit")))


@query(f"""WITH {NUMBERED}, l AS (SELECT l_orderkey AS doc, n, CASE WHEN l_partkey % 3 > 0 THEN strftime(l_shipdate, '%d/%m/%Y') END AS date, l_suppkey % 4 = 0 AS anchor FROM li),
  d AS (SELECT a.doc, a.n, a.date, min(abs(a.n - b.n)) AS dist, min(CASE WHEN b.n <= a.n THEN a.n - b.n END) AS back FROM l a LEFT JOIN l b ON a.doc = b.doc AND b.anchor WHERE a.date IS NOT NULL GROUP BY 1, 2, 3),
  k AS (SELECT doc, date, n, CASE WHEN dist <= 2 THEN dist ELSE 3 END AS d, CASE WHEN dist <= 2 AND coalesce(back, 1000000) > dist THEN 1 ELSE 0 END AS side FROM d),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY d, side, n) AS rn FROM k)
SELECT doc, date, d::INT AS distance FROM r WHERE rn = 1""")
def q08_nearest_date(spark, sf):
    rows = numbered(spark, sf).select(F.col("l_orderkey").alias("doc"), F.col("n").alias("line_no"), F.when(F.col("l_partkey") % 3 > 0, F.date_format("l_shipdate", "dd/MM/yyyy")).alias("date"), (F.col("l_suppkey") % 4 == 0).alias("anchor"))
    return X.nearest_date(rows)


def _squeezed(column: str) -> str:
    """SQL without back references: runs of four of each capital letter, one after the other."""
    for code in (*range(0x41, 0x5B), *range(0xC0, 0xDD)):
        column = f"regexp_replace({column}, '{chr(code)}{{4,}}', '{chr(code)}', 'g')"
    return column


@query(f"""SELECT doc_id, md5({_squeezed("text || ' AAAAAÇÇÇÇ' || repeat('B', (doc_id % 6)::INT)")}) AS squeezed FROM documents""")
def q16_repeat_squeeze(spark, sf):
    s = F.concat(F.col("text"), F.lit(" AAAAAÇÇÇÇ"), F.expr("repeat('B', cast(doc_id % 6 as int))"))
    return table(spark, sf, "documents").select("doc_id", F.md5(FI.squeezed_capitals(s)).alias("squeezed"))


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, length(text)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
  w AS (SELECT conv_id, turn, k, n AS used, 0 AS batch FROM r WHERE k = 1 UNION ALL SELECT r.conv_id, r.turn, r.k, CASE WHEN w.used > 0 AND w.used + r.n > 400 THEN r.n ELSE w.used + r.n END, w.batch + CASE WHEN w.used > 0 AND w.used + r.n > 400 THEN 1 ELSE 0 END FROM w JOIN r ON r.conv_id = w.conv_id AND r.k = w.k + 1)
SELECT conv_id, turn, batch::INT AS batch FROM w""")
def q17_batches(spark, sf):
    return L.batch_numbers(table(spark, sf, "conversations").withColumn("n", F.length("text")), "conv_id", "turn", "n", 400)


@query("""SELECT doc_id, 'Obra ' || doc_id AS name, length(text)::INT AS chars FROM documents""")
def q17_split_documents(spark, sf):
    docs = table(spark, sf, "documents")
    joined = docs.select("doc_id", L.page_envelope(F.concat(F.lit("Obra "), F.col("doc_id").cast("string")), F.lit(1), F.col("text")).alias("text"))
    parts = L.split_documents(joined)
    return parts.select(F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("doc_id"), "name", F.length("body").alias("chars"))


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events""")
def q34_noisy_json(spark, sf):
    p = F.col("props")
    noisy = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Resposta {curta}: "), p, F.lit(" fim } de {"))).otherwise(p)
    got = M.objects(table(spark, sf, "events").select("event_id", noisy.alias("answer")))
    return got.select("event_id", F.from_json("body", "k bigint")["k"].alias("k"))


@query("""SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages""")
def q35_html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.escape_xml(F.col("html"))).alias("escaped"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Sao Jose-SC' END AS city, CASE WHEN length(c_name) > 20 THEN left(c_name, 17) || '...' ELSE c_name END AS label FROM customer""")
def q36_city_and_label(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", T.city_uf(F.when(k % 2 == 0, "  SAO   JOSE ").otherwise("sao jose"), F.when(k % 3 == 0, "XX").otherwise("sc")).alias("city"), T.visual_cut(F.col("c_name")).alias("label"))


_BASE = "(p_partkey * 37 % 100000 + 100000)"
_MONEY = "replace(replace(replace(format('{{:,.2f}}', ({} + {}) / 100.0), ',', '_'), '.', ','), '_', '.')"


@query(f"""WITH t AS (SELECT p_partkey AS doc, p_partkey % 4 AS k, p_partkey % 3 AS m, {_BASE} AS b FROM part),
  every AS (SELECT doc, 1 AS o, 'R4-N' AS type, (b + 13) / 100.0 AS price FROM t WHERE k = 3 UNION ALL SELECT doc, 2, 'CSL-8', (b + 7) / 100.0 FROM t WHERE k > 1
    UNION ALL SELECT doc, 3 + j, ['R1', 'PP4', 'R16'][m + 1] || '-' || s, (b + j * 1111) / 100.0 FROM t, (VALUES ('B', 0), ('N', 1), ('A', 2)) v(s, j) WHERE k <> 0
    UNION ALL SELECT doc, 2.5, 'PP-4', b / 100.0 FROM t WHERE k <> 0 AND m = 1)
SELECT doc, type, round(price, 2)::DOUBLE AS price, CASE k WHEN 0 THEN '' WHEN 1 THEN 'Marco/2024' WHEN 2 THEN 'Janeiro/2026' ELSE 'Dezembro/2025' END AS month FROM every JOIN t USING (doc)""")
def q39_price_table(spark, sf):
    b, k = F.col("p_partkey") * 37 % 100000 + 100000, F.col("p_partkey") % 4
    money = lambda j: T.format_brl((b + j) / 100)
    label = F.get(F.array(*map(F.lit, ("R-1", "PP-4", "R-16"))), (F.col("p_partkey") % 3).cast("int"))
    triple = F.concat(*(x for j in (0, 1111, 2222) for x in (label, F.lit(" "), money(j), F.lit(" "))))
    more = F.when(k > 1, F.concat(F.lit("\nCSL-8: R$ "), money(7))).otherwise(""), F.when(k == 3, F.concat(F.lit("\nr4-n "), money(13))).otherwise("")
    text = F.when(k == 0, "sem tabela").otherwise(F.concat(triple, *more, F.when(k == 1, "\nreferencia: marco de 2024").otherwise("")))
    file = F.when(k == 2, "a_2026_02_CUB.pdf").when(k == 3, "2026_01_cub.pdf").otherwise("x.pdf")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), text.alias("text"), file.alias("file"))
    months = rows.select("doc", PR.reference_month(F.col("text"), F.col("file")).alias("month"))
    return PR.price_table(rows).join(months, "doc").select("doc", "type", F.round("price", 2).alias("price"), "month")


@query("""WITH i AS (SELECT o_custkey AS doc, o_orderstatus AS kind, o_orderkey AS position, 'p' || o_orderkey AS item FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY doc, kind ORDER BY position) AS n FROM i)
SELECT doc, kind, string_agg(item, '; ' ORDER BY position) AS text FROM n WHERE n <= CASE kind WHEN 'O' THEN 2 WHEN 'F' THEN 3 ELSE 1 END GROUP BY 1, 2""")
def q48_summary_lists(spark, sf):
    items = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("position"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("item"))
    return SE.summary_lists(items, {"O": 2, "F": 3, "P": 1})



@query("""WITH i AS (SELECT o_custkey AS doc, (o_orderkey % 3)::INT AS batch, ['resumo', 'dados_numericos', 'pendencias'][(o_orderkey % 5 % 3 + 1)::INT] AS kind, o_orderkey AS position FROM orders),
  j AS (SELECT *, CASE kind WHEN 'resumo' THEN 'areas' ELSE kind END AS name, row_number() OVER (PARTITION BY doc, batch, kind ORDER BY position) AS n FROM i),
  l AS (SELECT doc, batch, kind, '[' || name || ']' || chr(10) || string_agg('- p' || position, chr(10) ORDER BY position) AS t FROM j WHERE n <= CASE kind WHEN 'pendencias' THEN 10 ELSE 20 END GROUP BY doc, batch, kind, name),
  b AS (SELECT doc, batch, 'LOTE ' || batch || ':' || chr(10) || string_agg(t, chr(10) ORDER BY list_position(['resumo', 'dados_numericos', 'pendencias'], kind)) AS t FROM l GROUP BY doc, batch)
SELECT doc, md5(string_agg(t, chr(10) || chr(10) ORDER BY batch)) AS text FROM b GROUP BY doc""")
def q48b_batch_summaries(spark, sf):
    k = F.col("o_orderkey")
    kind = F.get(F.array(*map(F.lit, ("resumo", "dados_numericos", "pendencias"))), (k % 5 % 3).cast("int"))
    items = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), (k % 3).cast("int").alias("batch"), kind.alias("kind"), F.when(kind == "resumo", "areas").otherwise(kind).alias("name"), k.alias("position"), F.concat(F.lit("p"), k.cast("string")).alias("item"))
    return SE.batch_summaries(items).select("doc", F.md5("text").alias("text"))
