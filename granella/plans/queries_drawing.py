"""Queries of drawings: segments, classes, walls, cells, components, regions and SVG layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granella.operators import geometry as G
from granella.operators import svg as S
from granella.plans import drawings as W
from granella.plans.registry import query, sql_list
from granella.session import table
from granella.sources import files as FS

# ---- geometry ----------------------------------------------------------------------------------------------------

_SEG = """seg AS (SELECT l_orderkey % 50 AS page, l_orderkey * 8 + l_linenumber AS idx, l_partkey % 900 AS x0, l_suppkey * 37 % 900 AS y0, l_partkey % 900 + CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 4 ELSE 0 END AS x1, l_suppkey * 37 % 900 + CASE WHEN l_linenumber % 2 = 1 THEN l_quantity * 4 WHEN l_partkey % 11 = 0 THEN 5 ELSE 0 END AS y1 FROM lineitem WHERE l_linenumber <= 2)"""
_KIND = "CASE WHEN abs(x1 - x0) <= 0.5 AND abs(y1 - y0) <= 0.5 THEN 'ponto' WHEN abs(y1 - y0) <= 0.5 THEN 'horizontal' WHEN abs(x1 - x0) <= 0.5 THEN 'vertical' ELSE 'diagonal' END"
_NEAR = f"""{_SEG}, pts AS (SELECT l_orderkey % 50 AS page, (l_partkey * 7 % 1000)::DOUBLE AS px, ((l_suppkey * 91 + l_linenumber * 13) % 1000)::DOUBLE AS py, l_linenumber % 2 = 1 AS is_text FROM lineitem WHERE l_linenumber > 2),
  d AS (SELECT s.page, s.idx, px, py, is_text, x0, y0, x1, y1, (x1 - x0) AS dx, (y1 - y0) AS dy FROM seg s JOIN pts p ON s.page = p.page),
  t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0 ELSE least(greatest(((px - x0) * dx + (py - y0) * dy) / (dx * dx + dy * dy), 0.0), 1.0) END AS t FROM d),
  near AS (SELECT page, idx, x0, y0, x1, y1, sum(is_text::INT) AS texts, sum((NOT is_text)::INT) AS rects FROM t WHERE (px - (x0 + t * dx)) * (px - (x0 + t * dx)) + (py - (y0 + t * dy)) * (py - (y0 + t * dy)) <= 144 GROUP BY 1, 2, 3, 4, 5, 6)"""


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    n, x, y, size = F.col("l_linenumber"), F.col("l_partkey") % 900, F.col("l_suppkey") * 37 % 900, F.col("l_quantity") * 4
    x1 = x + F.when(n % 2 == 0, size).otherwise(0.0)
    y1 = y + F.when(n % 2 == 1, size).when(F.col("l_partkey") % 11 == 0, 5.0).otherwise(0.0)
    return table(spark, sf, "lineitem").filter("l_linenumber <= 2").select((F.col("l_orderkey") % 50).alias("page"), (F.col("l_orderkey") * 8 + n).alias("idx"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), x1.alias("x1"), y1.alias("y1"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter("l_linenumber > 2").select((F.col("l_orderkey") % 50).alias("page"), (F.col("l_partkey") * 7 % 1000).cast("double").alias("px"), ((F.col("l_suppkey") * 91 + F.col("l_linenumber") * 13) % 1000).cast("double").alias("py"), F.when(F.col("l_linenumber") % 2 == 1, "texts").otherwise("rects").alias("what"))


_ENDS = ("x0", "y0", "x1", "y1")


@query(f"WITH {_SEG} SELECT page, idx, {_KIND} AS kind, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 3) AS length FROM seg")
def q18_line_orientation(spark, sf):
    ends = [F.col(c) for c in _ENDS]
    return _segments(spark, sf).select("page", "idx", G.orientation(*ends).alias("kind"), G.length(*ends).alias("length"))


_CLASSED = f"""{_NEAR}, k AS (SELECT s.*, coalesce(n.texts, 0) AS texts, coalesce(n.rects, 0) AS rects, {_KIND} AS kind, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 3) AS len, (x0 + x1) / 2 > 720 AS r, (y0 + y1) / 2 > 720 AS b FROM seg s LEFT JOIN near n USING (page, idx, x0, y0, x1, y1)),
  classed AS (SELECT *, CASE WHEN kind = 'ponto' THEN '{G.THIN}/{G.IS_POINT}' WHEN len < 0.5 THEN '{G.THIN}/{G.NO_LENGTH}' WHEN len < 10 THEN '{G.SHORT}/{G.TOO_SHORT}' WHEN kind = 'diagonal' THEN '{G.DIAGONAL}/{G.IS_DIAGONAL}' WHEN r AND b THEN '{G.TITLE}/{G.IN_TITLE}'
    WHEN (r OR b) AND (texts >= 4 OR rects >= 3) THEN '{G.TITLE}/{G.NEAR_TITLE}' WHEN texts >= 4 THEN '{G.TEXT_NEAR}/{G.AMONG_TEXTS}' ELSE '{G.WALL}/{G.IS_WALL}' END AS c FROM k),
  bucketed AS (SELECT *, split_part(c, '/', 1) AS bucket, split_part(c, '/', 2) AS reason FROM classed)"""


def _classified(spark, sf) -> DataFrame:
    return W.classified(_segments(spark, sf), _points(spark, sf))


@query(f"WITH {_CLASSED} SELECT page, idx, texts::BIGINT AS texts, rects::BIGINT AS rects, bucket, reason FROM bucketed")
def q19_line_buckets(spark, sf):
    return _classified(spark, sf).select("page", "idx", "texts", "rects", "bucket", "reason")


@query(f"WITH {_CLASSED}, n AS (SELECT page, idx, bucket, row_number() OVER (PARTITION BY page ORDER BY list_position({sql_list(G.NOISE)}, bucket), idx) AS n FROM bucketed WHERE bucket <> '{G.WALL}') SELECT page, idx, bucket FROM n WHERE n <= 100")
def q19b_noise_budget(spark, sf):
    return W.noise(_segments(spark, sf), _points(spark, sf), 100)


_SHAPES = """shapes AS (SELECT l_orderkey % 50 AS page, l_orderkey * 8 + l_linenumber AS idx, CASE WHEN l_linenumber % 2 = 0 THEN 'rect' ELSE 'curve' END AS kind, (l_partkey * 3 % 950)::DOUBLE AS x0, (l_suppkey * 53 % 950)::DOUBLE AS top, l_partkey * 3 % 950 + l_quantity AS x1, l_suppkey * 53 % 950 + l_quantity / 2 AS bottom FROM lineitem)"""


def _shapes(spark, sf) -> DataFrame:
    x, y = (F.col("l_partkey") * 3 % 950).cast("double"), (F.col("l_suppkey") * 53 % 950).cast("double")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "rect").otherwise("curve")
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), kind.alias("kind"), x.alias("x0"), y.alias("top"), (x + F.col("l_quantity")).alias("x1"), (y + F.col("l_quantity") / 2).alias("bottom"))


@query(f"WITH {_SHAPES} SELECT page, idx, kind || '_candidates' AS bucket, kind || '_outside_titleblock' AS reason FROM shapes WHERE NOT ((x0 + x1) / 2 > 720 AND (top + bottom) / 2 > 720)")
def q19c_shapes(spark, sf):
    return G.shapes_outside_title(_shapes(spark, sf), 1000.0, 1000.0).select("page", "idx", "bucket", "reason")


@query(f"""WITH {_SHAPES}, e AS (SELECT page, kind || 's' AS kind FROM shapes UNION ALL SELECT l_orderkey % 50, 'lines' FROM lineitem WHERE l_linenumber = 1)
SELECT page::INT AS page, sum((kind = 'lines')::INT)::BIGINT AS lines, sum((kind = 'rects')::INT)::BIGINT AS rects, sum((kind = 'curves')::INT)::BIGINT AS curves, count(*) AS elements FROM e GROUP BY GROUPING SETS ((page), ())""")
def q19d_inventory(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_linenumber = 1").select((F.col("l_orderkey") % 50).alias("page"), F.lit("line").alias("kind"))
    every = _shapes(spark, sf).select("page", "kind").union(lines).select(F.lit("planta").alias("doc"), F.col("page").cast("int").alias("page"), "kind")
    return FS.inventory(every).select("page", "lines", "rects", "curves", "elements")


_WALLS = """walls AS (SELECT DISTINCT l_orderkey % 400 AS page, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS orient, ((l_partkey % 8) * 40 + 100)::DOUBLE AS pos, ((l_suppkey % 6) * 40 + 100)::DOUBLE AS s, ((l_suppkey % 6) * 40 + 100 + (l_quantity::INT % 5 + 1) * 40)::DOUBLE AS e FROM lineitem),
  g AS (SELECT *, sum(j) OVER (PARTITION BY page, orient ORDER BY pos RANGE UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY page, orient ORDER BY pos) > 2 THEN 1 ELSE 0 END AS j FROM walls)),
  i AS (SELECT *, sum(b) OVER (PARTITION BY page, orient, g ORDER BY s, e, pos ROWS UNBOUNDED PRECEDING) AS i, avg(pos) OVER (PARTITION BY page, orient, g) AS p FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY page, orient, g ORDER BY s, e, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 1 ELSE 0 END AS b FROM g)),
  merged AS (SELECT page, orient, round(any_value(p), 3) AS pos, min(s) AS s, max(e) AS e, count(*) AS sources FROM i GROUP BY page, orient, g, i)"""
_CELLS = f"""{_WALLS}, pos AS (SELECT page, orient, pos, lead(pos) OVER (PARTITION BY page, orient ORDER BY pos) AS nxt FROM (SELECT DISTINCT page, orient, pos FROM merged)),
  cand AS (SELECT x.page, x.pos AS l, x.nxt AS r, y.pos AS t, y.nxt AS b FROM pos x JOIN pos y ON x.page = y.page AND x.orient = 'v' AND y.orient = 'h' WHERE x.nxt IS NOT NULL AND y.nxt IS NOT NULL),
  cells AS (SELECT page, l, r, t, b, row_number() OVER (PARTITION BY page ORDER BY t, l)::INT AS cell, (r - l) * (b - t) AS area FROM cand c
    WHERE EXISTS (SELECT 1 FROM merged m WHERE m.page = c.page AND m.orient = 'h' AND m.pos = c.t AND m.s <= c.l + 2 AND m.e >= c.r - 2) AND EXISTS (SELECT 1 FROM merged m WHERE m.page = c.page AND m.orient = 'h' AND m.pos = c.b AND m.s <= c.l + 2 AND m.e >= c.r - 2)
      AND EXISTS (SELECT 1 FROM merged m WHERE m.page = c.page AND m.orient = 'v' AND m.pos = c.l AND m.s <= c.t + 2 AND m.e >= c.b - 2) AND EXISTS (SELECT 1 FROM merged m WHERE m.page = c.page AND m.orient = 'v' AND m.pos = c.r AND m.s <= c.t + 2 AND m.e >= c.b - 2))"""
_EDGES = f"""{_CELLS}, edges AS (SELECT DISTINCT a.page, least(a.cell, b.cell) AS src, greatest(a.cell, b.cell) AS dst FROM cells a JOIN cells b ON a.page = b.page AND a.cell <> b.cell
    WHERE (abs(a.r - b.l) <= 2 AND least(a.b, b.b) - greatest(a.t, b.t) >= greatest(2, 0.25 * least(a.b - a.t, b.b - b.t))) OR (abs(a.b - b.t) <= 2 AND least(a.r, b.r) - greatest(a.l, b.l) >= greatest(2, 0.25 * least(a.r - a.l, b.r - b.l))))"""
_COMPONENTS = f"""{_EDGES}, both_ways AS (SELECT page, src, dst FROM edges UNION ALL SELECT page, dst, src FROM edges),
  reach AS (SELECT page, cell, cell AS c FROM cells UNION SELECT r.page, b.dst, r.c FROM reach r JOIN both_ways b ON r.page = b.page AND r.cell = b.src),
  comps AS (SELECT page, cell, min(c) AS component FROM reach GROUP BY 1, 2)"""


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    s = ((F.col("l_suppkey") % 6) * 40 + 100).cast("double")
    walls = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 400).alias("page"), F.when(F.col("l_linenumber") % 2 == 0, "h").otherwise("v").alias("orient"), ((F.col("l_partkey") % 8) * 40 + 100).cast("double").alias("pos"), s.alias("start"), (s + (F.col("l_quantity").cast("int") % 5 + 1) * 40).alias("end")).distinct()
    return G.merge_segments(walls)


def _cells(spark, sf) -> DataFrame:
    return G.closed_cells(_merged(spark, sf))


@query(f"WITH {_WALLS} SELECT page, orient, pos, s AS start, e AS \"end\", sources FROM merged")
def q20_merge_segments(spark, sf):
    return _merged(spark, sf)


@query(f"WITH {_CELLS} SELECT page, cell, l AS \"left\", t AS top, r AS \"right\", b AS bottom, area FROM cells")
def q21_region_cells(spark, sf):
    return _cells(spark, sf).select("page", "cell", "left", "top", "right", "bottom", "area")


@query(f"WITH {_EDGES} SELECT page, src, dst FROM edges")
def q22_adjacency(spark, sf):
    return G.adjacency(_cells(spark, sf))


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT page, cell, component FROM comps")
def q23_components(spark, sf):
    cells = _cells(spark, sf)
    return G.page_components(cells, G.adjacency(cells))


_COMPOSITE_REASON = f"""CASE WHEN cells < 2 THEN '{G.SINGLE}' WHEN cells > 200 THEN '{G.MANY}' WHEN "right" - "left" < 20 THEN '{G.NARROW}' WHEN bottom - top < 20 THEN '{G.FLAT}' WHEN ("right" - "left") * (bottom - top) < 400 THEN '{G.SMALL}' WHEN fill < 0.05 THEN '{G.SPARSE}'
  WHEN ("right" - "left") * (bottom - top) > 250000 THEN '{G.LARGE}' WHEN round(("right" - "left") / 1000, 4) > 0.5 THEN '{G.WIDE}' WHEN round((bottom - top) / 1000, 4) > 0.5 THEN '{G.HIGH}' ELSE '' END"""


@query(f"""WITH RECURSIVE {_COMPONENTS}, k AS (SELECT page, component, count(*) AS cells, min(l) AS "left", min(t) AS top, max(r) AS "right", max(b) AS bottom, sum(area) AS a FROM cells JOIN comps USING (page, cell) GROUP BY 1, 2),
  n AS (SELECT e.page, component, count(*) AS edges FROM edges e JOIN comps c ON c.page = e.page AND c.cell = e.src GROUP BY 1, 2),
  f AS (SELECT k.*, coalesce(edges, 0) AS edges, round(a / (("right" - "left") * (bottom - top)), 4) AS fill FROM k LEFT JOIN n USING (page, component))
SELECT page, component, cells, "left", top, "right", bottom, edges, fill, {_COMPOSITE_REASON} AS reason FROM f""")
def q24_composites(spark, sf):
    cells = _cells(spark, sf)
    edges = G.adjacency(cells)
    return G.composites(cells, G.page_components(cells, edges), edges).select("page", "component", "cells", "left", "top", "right", "bottom", "edges", "fill", "reason")


@query(f"""WITH {_SEG}, n AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY idx, x0, y0, x1, y1) AS n, '<line class="' || {_KIND} || '" x1="' || x0::BIGINT || '" y1="' || y0::BIGINT || '" x2="' || x1::BIGINT || '" y2="' || y1::BIGINT || '"/>' AS element FROM seg)
SELECT page, count(*) AS n, md5('<g id="lines">' || string_agg(element, '' ORDER BY n) || '</g>') AS body FROM n WHERE n <= 200 GROUP BY page""")
def q33_svg_layers(spark, sf):
    items = _segments(spark, sf).withColumn("element", S.line_element(G.orientation(*(F.col(c) for c in _ENDS))))
    return S.layer(items, "lines", 200, ["idx", *_ENDS]).select("page", "n", F.md5("body").alias("body"))


def _xml(s: str) -> str:
    return f"replace(replace(replace({s}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_NUM = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE round({0}, 3)::VARCHAR END"


def _box(css: str, title: str) -> str:
    """SQL: the element of a shape's box."""
    parts = [f"""'<rect class="{css}" x="' || {_NUM.format('x0')}""", f"""'" y="' || {_NUM.format('top')}""", f"""'" width="' || {_NUM.format('(x1 - x0)')}""", f"""'" height="' || {_NUM.format('(bottom - top)')}"""]
    return " || ".join(parts) + (f" || '\"><title>' || {_xml(title)} || '</title></rect>'" if title else " || '\"/>'")


_SHAPE_TITLE = f"""'bucket=' || kind || '_candidates | reason=' || kind || '_outside_titleblock | bbox=(' || {_NUM.format('x0')} || ',' || {_NUM.format('top')} || ')+' || {_NUM.format('(x1 - x0)')} || 'x' || {_NUM.format('(bottom - top)')}"""


@query(f"""WITH {_SHAPES}, k AS (SELECT * FROM shapes WHERE NOT ((x0 + x1) / 2 > 720 AND (top + bottom) / 2 > 720)), e AS (SELECT page, kind, x0, top, x1, bottom, idx, CASE kind WHEN 'rect' THEN {_box('cls-rect', _SHAPE_TITLE)} ELSE {_box('cls-curve', _SHAPE_TITLE)} END AS element FROM k),
  n AS (SELECT *, row_number() OVER (PARTITION BY page, kind ORDER BY x0, top, x1, bottom, idx) AS n FROM e)
SELECT page, 'layer-' || kind || '-candidates' AS layer, count(*) AS n, md5('<g id="layer-' || kind || '-candidates">' || string_agg(element, '' ORDER BY n) || '</g>') AS body FROM n WHERE n <= 500 GROUP BY page, kind""")
def q33b_shape_layers(spark, sf):
    shapes = G.shapes_outside_title(_shapes(spark, sf), 1000.0, 1000.0)
    one = lambda kind: S.layer(shapes.filter(F.col("kind") == kind).withColumn("element", S.shape_element(f"cls-{kind}", S.shape_title())), f"layer-{kind}-candidates", 500, ["x0", "top", "x1", "bottom", "idx"])
    return one("rect").union(one("curve")).select("page", "layer", "n", F.md5("body").alias("body"))


@query(f"""WITH {_CLASSED}, n AS (SELECT page, count(*) AS lines, sum((bucket = '{G.WALL}')::INT) AS walls FROM bucketed GROUP BY page)
SELECT page, {{"".join(())}}'<svg xmlns="http://www.w3.org/2000/svg" width="1000pt" height="1000pt" viewBox="0 0 1000 1000"><metadata><nbr12721:vectorClassificationDebug>{{"page_number":' || page || ',"stats":{{"input_lines":' || lines || ',"wall_candidates":' || walls || '}}}}</nbr12721:vectorClassificationDebug></metadata>' AS head,
  true AS legend, walls::BIGINT AS walls FROM n""".replace('{"".join(())}', ""))
def q33c_classified_page(spark, sf):
    """How a classified page's drawing begins, whether it has its legend, and how many walls it draws."""
    page = S.classified_page(_classified(spark, sf), G.shapes_outside_title(_shapes(spark, sf), 1000.0, 1000.0), 1000.0, 1000.0)
    return page.select("page", F.regexp_extract("svg", "^(.*?</metadata>)", 1).alias("head"), F.contains("svg", F.lit(S.legend(tuple(e for e in S.CLASS_LEGEND if e[1] != "cls-axis"), 1000.0, 135, 145))).alias("legend"), F.regexp_count("svg", F.lit('class="cls-wall" x1')).cast("long").alias("walls"))


@query(f"""WITH {_CELLS}, k AS (SELECT page, cell, l, t, CASE WHEN r - l < 8 THEN '{G.NARROW}' WHEN b - t < 8 THEN '{G.FLAT}' WHEN area < 100 THEN '{G.SMALL}' WHEN area > 0.25 * 5000 THEN '{G.LARGE}' ELSE '' END AS reason FROM cells),
  n AS (SELECT *, row_number() OVER (PARTITION BY page, reason = '' ORDER BY t, l) AS n FROM k)
SELECT page, cell, reason, CASE WHEN reason = '' THEN '{G.ACCEPTED_CONFIDENCE}' ELSE '{G.REJECTED_CONFIDENCE}' END AS confidence, 'p' || lpad(page::VARCHAR, 3, '0') || CASE WHEN reason = '' THEN '_r' ELSE '_x' END || lpad(n::VARCHAR, 4, '0') AS region FROM n""")
def q44_regions(spark, sf):
    return G.regions(_cells(spark, sf), 100.0, 50.0).select("page", "cell", "reason", "confidence", "region")


@query(f"""WITH {_CELLS}, w AS (SELECT c.page, c.cell, s.side, max(m.sources) AS n FROM cells c, (VALUES ('top'), ('right'), ('bottom'), ('left')) s(side) JOIN merged m ON m.page = c.page AND CASE side WHEN 'top' THEN m.orient = 'h' AND m.pos = c.t AND m.s <= c.l + 2 AND m.e >= c.r - 2
    WHEN 'bottom' THEN m.orient = 'h' AND m.pos = c.b AND m.s <= c.l + 2 AND m.e >= c.r - 2 WHEN 'left' THEN m.orient = 'v' AND m.pos = c.l AND m.s <= c.t + 2 AND m.e >= c.b - 2 ELSE m.orient = 'v' AND m.pos = c.r AND m.s <= c.t + 2 AND m.e >= c.b - 2 END GROUP BY 1, 2, 3)
SELECT page, cell, string_agg(side || ':' || n, ',' ORDER BY list_position(['top', 'right', 'bottom', 'left'], side)) AS edges, any_value((l / 3)::INT) AS key_x, any_value((t / 3)::INT) AS key_y FROM w JOIN (SELECT page, cell, floor(l / 3) * 3 AS l, floor(t / 3) * 3 AS t FROM cells) USING (page, cell) GROUP BY page, cell""")
def q44b_region_edges(spark, sf):
    key = G.box_key(*(F.col(c) for c in ("left", "top", "right", "bottom")), 3.0)
    return _cells(spark, sf).select("page", "cell", G.edge_sources().alias("edges"), key["x0"].alias("key_x"), key["top"].alias("key_y"))
