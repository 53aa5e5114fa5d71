"""Counts of near points, by intervals instead of pairs."""

import random

from pyspark.sql import functions as F

from granella.operators import geometry as G


def test_near_counts_meet_no_pairs(spark):
    r = random.Random(5)
    at = lambda whole: (float(r.randrange(300)) if whole else r.random() * 300) - 20
    points = [(r.choice(["a", "b"]), at(i % 3 < 2), at(i % 3 < 2), r.choice(["texts", "rects", "other"])) for i in range(1500)] + [(None, 1.0, 1.0, "texts")]
    segments = []
    for i in range(240):
        x, y, n = at(i % 3 < 2), at(i % 3 < 2), at(True)
        segments.append((r.choice(["a", "b", "c"]), i, x, y, *[(x + n, y), (x, y + n), (x + n, y + 5), (at(True), at(True)), (x, y)][i % 5]))
    segments += [("a", 900, None, 1.0, 2.0, 2.0), (None, 901, 1.0, 1.0, 2.0, 2.0)]
    s, p = spark.createDataFrame(segments, "page string, idx int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(points, "page string, px double, py double, what string")
    got = G.near_counts(s, p, 12.0, kinds=("texts", "rects"))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    inside = G.point_segment_distance2(*(F.col(c) for c in ("px", "py", "x0", "y0", "x1", "y1"))) <= 144
    pairs = s.join(p, "page", "left").groupBy(*s.columns).agg(*(F.coalesce(F.sum((inside & (F.col("what") == k)).cast("long")), F.lit(0)).alias(k) for k in ("texts", "rects")))
    rows = lambda d: sorted(map(tuple, d.select(*s.columns, "texts", "rects").collect()), key=repr)
    assert rows(got) == rows(pairs)
    assert G.near_counts(s, p, 12.0).agg(F.sum("near")).first()[0] == s.join(p, "page").filter(inside).count()
