"""A classified page is drawn in one pass, and its limits are those of its layers."""

import random

import pytest
from pyspark.sql import functions as F

from granella.operators import geometry as G
from granella.operators import svg as S


def _layers(lines, shapes, axis, most_noise):
    """The same layers, each by itself."""
    element = lambda css: S.line_element(F.lit(css), S.line_title())
    out = []
    if axis:
        out.append(S.layer(lines.filter(G.long_axis_line(F.col("length"), F.col("kind"))).withColumn("element", element("cls-axis")), "layer-axis-aligned", S.MOST_LINES, ["idx"]))
    for kind in ("curve", "rect"):
        out.append(S.layer(shapes.filter(F.col("kind") == kind).withColumn("element", S.shape_element(f"cls-{kind}", S.shape_title())), f"layer-{kind}-candidates", S.MOST_CURVES, ["x0", "top", "x1", "bottom"]))
    rank = F.array_position(F.array(*map(F.lit, G.NOISE)), F.col("bucket"))
    noise = G.budget(lines.filter(F.col("bucket").isin(*G.NOISE)), [rank, F.col("idx")], most_noise)
    for bucket in (*G.NOISE, G.WALL):
        name, css = S.BUCKET_LAYERS[bucket]
        own = lines.filter(F.col("bucket") == G.WALL) if bucket == G.WALL else noise.filter(F.col("bucket") == bucket)
        out.append(S.layer(own.withColumn("element", element(css)), name, S.MOST_LINES, ["idx"]))
    stats = lines.groupBy("page").agg(F.count("*").alias("input_lines"), F.sum((F.col("bucket") == G.WALL).cast("long")).alias("wall_candidates"))
    head = stats.select("page", S.metadata("vectorClassificationDebug", F.struct(F.col("page").alias("page_number"), F.struct("input_lines", "wall_candidates").alias("stats"))).alias("meta"))
    entries = S.CLASS_LEGEND if axis else tuple(e for e in S.CLASS_LEGEND if e[1] != "cls-axis")
    return S.pages(out, 1000.0, 1000.0, "page", S.legend(entries, 1000.0, 135, 145), head)


@pytest.mark.parametrize(("axis", "most_noise"), [(False, 9), (True, 40)])
def test_page_equals_its_layers(spark, monkeypatch, axis, most_noise):
    monkeypatch.setattr(S, "MOST_LINES", 12)
    monkeypatch.setattr(S, "MOST_CURVES", 7)
    r = random.Random(3)
    lines = [(p, i, r.random() * 90, 5.0 * i, 40.0, 7.5, r.choice(["horizontal", "vertical", "diagonal"]), r.random() * 40, r.choice([G.WALL, *(G.NOISE * (p != "walls"))]), "why") for p in ("a", "walls", None) for i in range(60)]
    lines += [("c", 1, 1.0, 2.0, 3.0, 4.0, "horizontal", 5.0, "unknown", "why"), ("d", 1, 1.0, 2.0, 3.0, 4.0, "horizontal", 5.0, G.SHORT, "a & b")]
    shapes = [(p, kind, x, float(r.randrange(9)), 50.0, 60.0 + i, f"{kind}_candidates", "why") for p in ("a", "shapes", None) for kind in ("rect", "curve", "other") for i in range(30) for x in [r.choice([None, float("nan"), r.random() * 4, float(r.randrange(4))])]]
    s = spark.createDataFrame(lines, "page string, idx long, x0 double, y0 double, x1 double, y1 double, kind string, length double, bucket string, reason string")
    b = spark.createDataFrame(shapes, "page string, kind string, x0 double, top double, x1 double, bottom double, bucket string, reason string")
    got = S.classified_page(s, b, 1000.0, 1000.0, axis, most_noise)
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert rows(got) == rows(_layers(s, b, axis, most_noise))


def test_page_is_dealt_once(spark):
    lines = spark.range(10).selectExpr("id % 2 as page", "id as idx", "1D as x0", "1D as y0", "9D as x1", "1D as y1", "'horizontal' as kind", "8D as length", "'short_noise' as bucket", "'why' as reason")
    shapes = spark.range(10).selectExpr("id % 2 as page", "'rect' as kind", "1D as x0", "1D as top", "2D as x1", "2D as bottom", "'rect_candidates' as bucket", "'why' as reason")
    plan = S.classified_page(lines, shapes, 1000.0, 1000.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3  # pages, and the counts of units
