"""The drawing run: segments, shapes and texts to classes, merged walls, cells, regions, composites and overlays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granella.operators import geometry as G
from granella.operators import svg as S

ENDS = ("x0", "y0", "x1", "y1")


@dataclass
class Run:
    classified: DataFrame
    shapes: DataFrame
    cells: DataFrame
    regions: DataFrame
    composites: DataFrame
    overlays: DataFrame


def classified(segments: DataFrame, points: DataFrame, width: float = 1000.0, height: float = 1000.0) -> DataFrame:
    """segments (page, idx, x0, y0, x1, y1) with kind, length, near texts and rects, bucket and reason. points: (page, px, py, what), what is texts or rects."""
    ends = [F.col(c) for c in ENDS]
    near = G.near_counts(segments, points, G.NEAR_RADIUS, kinds=("texts", "rects")).withColumns({"kind": G.orientation(*ends), "length": G.length(*ends)})
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    found = near.withColumn("_c", G.classify(F.col("length"), F.col("kind"), cx, cy, F.col("texts"), F.col("rects"), width, height))
    return found.select(*near.columns, "_c.bucket", "_c.reason")


def noise(segments: DataFrame, points: DataFrame, limit: int, width: float = 1000.0, height: float = 1000.0) -> DataFrame:
    """(page, idx, bucket) of classified lines that are noise, within a budget that a page's buckets share in the order of G.NOISE.

    Diagonal lines are first in the budget and known without points. Where they
    use it up no other line can enter, so near points are counted on the other pages.
    """
    ends = [F.col(c) for c in ENDS]
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    bucket = G.classify(G.length(*ends), G.orientation(*ends), cx, cy, F.lit(0), F.lit(0), width, height)["bucket"]
    first = segments.filter(bucket == G.NOISE[0]).distinct()
    full = first.groupBy("page").agg(F.count("*").alias("n")).filter(F.col("n") >= limit).select("page")
    others = classified(segments.join(full, "page", "left_anti"), points.join(full, "page", "left_anti"), width, height)
    every = first.join(full, "page", "left_semi").select("page", "idx", F.lit(G.NOISE[0]).alias("bucket")).union(others.filter(F.col("bucket").isin(*G.NOISE)).select("page", "idx", "bucket"))
    rank = F.array_position(F.array(*map(F.lit, G.NOISE)), F.col("bucket"))
    return G.budget(every, [rank, F.col("idx")], limit)


def walls(lines: DataFrame) -> DataFrame:
    """Wall candidates as (page, orient, pos, start, end)."""
    flat = F.col("kind") == "horizontal"
    own = lines.filter((F.col("bucket") == G.WALL) & F.col("kind").isin("horizontal", "vertical"))
    return own.select("page", F.when(flat, "h").otherwise("v").alias("orient"), F.when(flat, (F.col("y0") + F.col("y1")) / 2).otherwise((F.col("x0") + F.col("x1")) / 2).alias("pos"), F.when(flat, F.least("x0", "x1")).otherwise(F.least("y0", "y1")).alias("start"), F.when(flat, F.greatest("x0", "x1")).otherwise(F.greatest("y0", "y1")).alias("end"))


def run(segments: DataFrame, texts: DataFrame, shapes: DataFrame | None = None, width: float = 1000.0, height: float = 1000.0) -> Run:
    """segments (page, idx, x0, y0, x1, y1), texts (page, px, py, label), shapes (page, kind, x0, top, x1, bottom)."""
    if shapes is None:
        shapes = segments.sparkSession.createDataFrame([], f"page {segments.schema['page'].dataType.simpleString()}, kind string, x0 double, top double, x1 double, bottom double")
    centres = shapes.filter("kind = 'rect'").select("page", ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("top") + F.col("bottom")) / 2).alias("py"), F.lit("rects").alias("what"))
    lines = classified(segments, texts.select("page", "px", "py", F.lit("texts").alias("what")).union(centres), width, height)
    outside = G.shapes_outside_title(shapes, width, height)
    cells = G.closed_cells(G.merge_segments(walls(lines)))
    edges = G.adjacency(cells)
    composites = G.composites(cells, G.page_components(cells, edges), edges, width, height)
    return Run(lines, outside, cells, G.regions(cells, width, height), composites, S.classified_page(lines, outside, width, height))
